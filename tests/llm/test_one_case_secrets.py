"""Random strings of one letter case and random letter groups are no identifiers; words are."""

import random
import string

import pytest

from pumpwise.llm import secrets


@pytest.fixture(scope="module")
def encoding():
    return secrets.load_encoding(secrets.VOCABULARY)


@pytest.mark.parametrize("alphabet", [string.ascii_uppercase, string.ascii_lowercase])
@pytest.mark.parametrize("length", [20, 24, 40])
def test_one_case_strings(encoding, alphabet, length):
    rng = random.Random(length)
    keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(300)]
    found = [secrets.random_spans(f"key {k} ok", [], encoding) == [(4, 4 + length, "random")] for k in keys]
    assert sum(found) >= 0.97 * len(keys)


def test_letter_groups_and_joined_keys(encoding):
    rng = random.Random(2)
    for n, k in ((5, 5), (7, 3)):
        keys = ["-".join("".join(rng.choices(string.ascii_uppercase, k=k)) for _ in range(n)) for _ in range(300)]
        assert sum(bool(secrets.random_spans(s, [], encoding)) for s in keys) >= 0.97 * len(keys)
    assert secrets.random_spans("production_XKQZVWPJTRNMHDGBFLYC", [], encoding)


def test_words_stay_out(encoding):
    for s in ("internationalization_configuration_manager", "Donaudampfschifffahrtsgesellschaft", "HTTP-XML-JSON-API-SQL-CSV-TEXT",
              "a/b/c/d/e/f/g/h/i/j/k/l", "2024-01-31-monthly-report-12", "CONFIGURATION_MANAGER_DEFAULT"):
        assert not secrets.random_spans(s, [], encoding), s
