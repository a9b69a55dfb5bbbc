"""A PySpark engine that turns many differently shaped fuel-price feeds into one table of stations and prices."""
