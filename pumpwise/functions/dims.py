"""Source fuel codes, countries, brands and lists that results must agree on."""

# Fixed values: (source code, fuel type, unit), in the order in which prices are listed.
POI_FUELS = [
    ("EURO98", "E5", "L"), ("SUPER_E5", "E5", "L"), ("DIESEL", "DIESEL", "L"), ("DIESEL_SPECIAL", "DIESEL", "L"), ("LPG", "LPG", "L"),
    ("AUTOGAS", "LPG", "L"), ("CNG", "CNG", "kg"), ("E85", "E85", "L"), ("HVO", "HVO100", "L"), ("HVO100", "HVO100", "L"),
]
SE_FUELS = [
    ("95", "E10", "L"), ("98", "E5", "L"), ("diesel", "DIESEL", "L"), ("biodiesel", "HVO100", "L"), ("etanol", "E85", "L"),
    ("fordonsgas", "CNG", "kg")
]
AT_FUELS = [("DIE", "DIESEL", "L"), ("SUP", "E5", "L"), ("LPG", "LPG", "L")]
PT_FUELS = [("2101", "DIESEL", "L"), ("3201", "E5", "L"), ("3400", "E5", "L"), ("1120", "LPG", "L")]
RO_FUELS = [("Benzina_Regular", "E5", "L"), ("Motorina_Regular", "DIESEL", "L"), ("GPL", "LPG", "L")]
IT_FUELS = [
    ("Benzina", "E5", "L"), ("Gasolio", "DIESEL", "L"), ("Gasolio BTZ", "DIESEL", "L"), ("GPL", "LPG", "L"), ("Metano", "CNG", "kg"),
    ("HVO", "HVO100", "L"), ("Bioetanolo E85", "E85", "L"),
]
SI_FUELS = [
    ("95", "E5", "L"), ("98", "E5", "L"), ("100", "E5", "L"), ("dizel", "DIESEL", "L"), ("dizel-premium", "DIESEL", "L"),
    ("avtoplin-lpg", "LPG", "L"), ("hvo", "HVO100", "L"), ("cng", "CNG", "kg"),
]
HR_FUELS = [
    ("1", "E5", "L"), ("2", "E5", "L"), ("5", "E5", "L"), ("6", "E5", "L"), ("7", "DIESEL", "L"), ("8", "DIESEL", "L"), ("9", "LPG", "L"),
    ("12", "E85", "L"), ("13", "HVO100", "L"), ("26", "CNG", "kg"),
]
FR_FUELS = [
    ("gazole_prix", "DIESEL", "L"), ("sp95_prix", "E5", "L"), ("sp98_prix", "E5", "L"), ("e10_prix", "E10", "L"), ("e85_prix", "E85", "L"),
    ("gplc_prix", "LPG", "L"),
]
ES_FUELS = [
    ("Precio Gasoleo A", "DIESEL", "L"), ("Precio Gasolina 95 E5", "E5", "L"), ("Precio Gasolina 95 E10", "E10", "L"),
    ("Precio Gasolina 98 E5", "E5", "L"), ("Precio Gases licuados del petroleo", "LPG", "L"),
    ("Precio Gas Natural Comprimido", "CNG", "kg"),
    ("Precio Bioetanol", "E85", "L"), ("Precio Hidrogeno", "H2", "kg"),
]
DE_FUELS = [("e5", "E5", "L"), ("e10", "E10", "L"), ("diesel", "DIESEL", "L")]
IS_FUELS = [("bensin95", "E5", "L"), ("diesel", "DIESEL", "L")]
NO_FUELS = [("0", "E10", "L"), ("1", "DIESEL", "L")]
FI_FUELS = [("E10", "L"), ("E5", "L"), ("DIESEL", "L")]
# Fixed values: (type, octane or None for any, fuel type); (keyword, fuel type) of which the first that occurs decides.
DK_OCTANES = [("Autobenzin", "95", "E10"), ("Autobenzin", "98", "E5"), ("Autodiesel", None, "DIESEL")]
DK_KEYWORDS = [
    ("95 E10", "E10"), ("95 Extra", "E5"), ("95", "E10"), ("Diesel Extra", "DIESEL"), ("Diesel", "DIESEL"), ("HVO", "HVO100"),
    ("Gas", "LPG")
]
# Old brand key, current one.
BRAND_ALIASES = {"shell": "st1", "statoil": "circlek"}
# Finnish page names that are brands.
FI_BRAND_SLUGS = [
    "A24", "ABC", "Esso", "Futura", "Neste", "Neste_Oil", "Neste_Oil_Express", "Nex", "Ritoil", "Seo", "Shell", "ShellExpress", "St1",
    "Teboil", "Teboil_Express", "Ysi5",
]
# Romanian station networks.
RO_NETWORKS = [
    "Gazprom", "Lukoil", "Mol", "OMV", "Petrom", "Rompetrol", "Socar", "ALD", "BLKOil", "CellyRo", "Dacma", "DHR", "Metropoli", "Ozana",
    "Petrolium", "Petromar", "RST", "TEAutohof", "VhExtraOil",
]
# Norwegian cities that carry the national average when no station is known.
NO_MARKERS = [
    ("Oslo", 59.9139, 10.7522), ("Bergen", 60.3913, 5.3221), ("Trondheim", 63.4305, 10.3951), ("Stavanger", 58.97, 5.7331),
    ("Tromsø", 69.6496, 18.956),
]
# Min lat, min lon, max lat, max lon in which coordinates are believed.
BOUNDS = {"IT": (35.0, 6.0, 48.0, 19.0), "PT": (36.0, -10.0, 43.0, -5.5), "SI": (45.4, 13.3, 46.9, 16.7), "RO": (43.5, 22.0, 48.4, 30.2), "HR": (42.3, 13.4, 46.9, 19.5)}
# Sources with an adapter of their own: country, currency, source, confidence.
SOURCES = [
    ("SE", "SEK", "openstreetmap.org + bensinpriser.nu", 0.8), ("NO", "NOK", "openstreetmap.org (locations) + ssb.no (national avg)", 0.75),
    ("DK", "DKK", "shell+q8+anwb.nl open APIs", 1.0),
    ("FI", "EUR", "polttoaine.net + anwb.nl", 0.7), ("IS", "ISK", "gasvaktin.is", 0.9), ("DE", "EUR", "tankerkoenig.de (MTS-K)", 0.99),
    ("FR", "EUR", "data.economie.gouv.fr", 0.95), ("ES", "EUR", "minetur.gob.es", 0.95), ("PT", "EUR", "dgeg.gov.pt", 1.0),
    ("AT", "EUR", "e-control.at", 1.0), ("IT", "EUR", "mimit.gov.it", 0.9), ("SI", "EUR", "goriva.si", 1.0),
    ("HR", "EUR", "mzoe-gor.hr", 1.0),
    ("RO", "RON", "peco-online.ro", 0.9),
]
POI_SOURCE = "anwb.nl (ANWB POI API)"
# Country, ISO-3, min lat, min lon, max lat, max lon, currency, confidence of the point-of-interest feed.
POI_COUNTRIES = [
    ("NL", "NLD", 50.75, 3.36, 53.55, 7.22, "EUR", 0.9), ("BE", "BEL", 49.5, 2.5, 51.5, 6.4, "EUR", 0.9),
    ("LU", "LUX", 49.44, 5.73, 50.18, 6.53, "EUR", 0.9),
    ("CH", "CHE", 45.8, 5.9, 47.8, 10.5, "CHF", 0.85), ("PL", "POL", 49.0, 14.1, 54.9, 24.1, "PLN", 0.85),
    ("HU", "HUN", 45.7, 16.1, 48.6, 22.9, "HUF", 0.85),
    ("CZ", "CZE", 48.55, 12.1, 51.06, 18.87, "CZK", 0.85), ("SK", "SVK", 47.73, 16.84, 49.62, 22.57, "EUR", 0.85),
    ("EE", "EST", 57.52, 21.83, 59.68, 28.21, "EUR", 0.85),
    ("LV", "LVA", 55.68, 20.97, 57.84, 28.24, "EUR", 0.85), ("LT", "LTU", 53.9, 20.95, 56.45, 26.83, "EUR", 0.85),
    ("GR", "GRC", 34.7, 19.3, 41.8, 29.7, "EUR", 0.9),
    ("BG", "BGR", 41.23, 22.36, 44.22, 28.69, "BGN", 0.9), ("RS", "SRB", 42.23, 18.84, 46.19, 23.01, "RSD", 0.9),
    ("ME", "MNE", 41.87, 18.43, 43.57, 20.36, "EUR", 0.9),
    ("MK", "MKD", 40.85, 20.44, 42.37, 23.04, "MKD", 0.9), ("AL", "ALB", 39.63, 19.27, 42.68, 21.06, "ALL", 0.9),
    ("BA", "BIH", 42.55, 15.72, 45.28, 19.62, "BAM", 0.9),
    ("XK", "XKX", 41.85, 20.01, 43.27, 21.79, "EUR", 0.9), ("AD", "AND", 42.43, 1.41, 42.66, 1.79, "EUR", 0.9),
    ("MD", "MDA", 45.47, 26.62, 48.49, 30.14, "MDL", 0.9),
    ("MT", "MLT", 35.78, 14.18, 36.08, 14.58, "EUR", 0.9), ("CY", "CYP", 34.63, 32.26, 35.71, 34.59, "EUR", 0.9),
    ("LI", "LIE", 47.05, 9.47, 47.27, 9.64, "CHF", 0.9),
    ("DK", "DNK", 54.8, 8.0, 57.8, 15.2, "DKK", 0.9), ("FI", "FIN", 59.81, 19.09, 70.09, 31.59, "EUR", 0.9),
    ("DE", "DEU", 47.27, 5.87, 55.06, 15.04, "EUR", 0.9),
    ("ES", "ESP", 36.0, -9.3, 43.8, 3.4, "EUR", 0.9),
]
# Centres of the 25 km circles that cover Germany, in the order of the first that answers.
DE_GRID = [
    (53.5753, 10.0153), (53.0793, 8.8017), (52.3759, 9.732), (53.1435, 11.0533), (54.3233, 10.1228), (54.0865, 12.1444), (53.8667, 10.6867),
    (51.4556, 7.0116),
    (51.2217, 6.7762), (50.9333, 6.95), (50.7753, 6.0839), (50.3569, 7.589), (50.1109, 8.6821), (49.9929, 8.2473), (49.4521, 11.0767),
    (48.9667, 12.0667),
    (48.5658, 13.4317), (48.3717, 10.8983), (48.1351, 11.582), (47.801, 13.0452), (47.999, 7.8421), (47.5595, 9.6753), (48.7758, 9.1829),
    (49.0069, 8.4037),
    (51.9607, 7.6261), (51.5167, 9.9167), (51.3397, 12.3731), (51.4818, 11.9699), (51.0504, 13.7373), (51.7535, 14.6329), (52.52, 13.405),
    (52.6367, 13.2353),
    (52.1205, 11.6276), (50.9272, 11.5861), (53.4285, 14.5528), (54.5086, 13.6), (50.0755, 14.4378), (51.36, 10.0), (49.7, 9.95),
    (50.57, 9.68),
]
# All countries in the order of publication.
COUNTRY_ORDER = (
    "SE NO DK FI IS DE FR ES AD PT NL BE LU CH LI AT CZ SK PL HU IT MT SI HR BA ME RS XK MK AL GR CY EE LV LT RO BG MD"
).split()
