import re

import pytest

from tidegauge.llm.pseudonyms import KEY, luhn, permute, pseudonymised, replaced, replacer

replace = replacer(KEY)
VALUES = ["a.99@mail2.example.com", "97.51.17.173", "+1 (523) 555-1055", "4532015112830366", "4532-0151-1283-0366", "04dbebab91ab85687d33eeaaf9ac699e1188f962",
          "123-45-6789", "2024-02-29", "29.02.2024", "31/12/1999", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 2 ** 12])
def test_a_permutation(size):
    assert sorted(permute(i, size, KEY, "t") for i in range(size)) == list(range(size))
    assert size < 90 or [permute(i, size, b"other", "t") for i in range(size)] != [permute(i, size, KEY, "t") for i in range(size)]


@pytest.mark.parametrize("value", VALUES)
def test_format_and_linkage(value):
    new, spans = replace(f"see {value}### and {value}, end")
    kind, start, end = spans[0]
    assert len(spans) == 2 and value not in new and value[:len(value)] == f"see {value}"[start:end]
    assert re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", new)) == re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", f"see {value}### and {value}, end")) or kind in ("ip", "secret")
    first = new[4:new.index("###")]
    assert new.count(first) == 2
    if kind == "card":
        digits = re.sub(r"\D", "", first)
        assert luhn(digits[:-1]) == int(digits[-1])
    if kind == "ip":
        assert all(0 <= int(p) < 256 for p in first.split("."))


@pytest.mark.parametrize("text", ["version 1.2.3", "300.1.1.1", "1.2.3.4.5", "4532015112830367", "2024-02-30", "1850-01-01", "666-45-6789", "a@b", "", "plain words", "0" * 9])
def test_what_is_not_valid_stays(text):
    assert replace(text) == (text, [])


@pytest.mark.parametrize("kind, value, before, behind", [
    ("card", "4111 1111 1111 1111", "card ", " 12/27"), ("card", "4111 1111 1111 1111", "", " 123"), ("card", "4111-1111-1111-1111", "", "-12 x"),
    ("card", "4111111111111111", "", " 12 3"), ("card", "4111 1111 1111 1111", "no 12 ", ""), ("card", "4222222222222", "", " 2027"),
    ("iban", "AT61 1904 3002 3457 3201", "to ", " BIC"), ("iban", "AT611904300234573201", "", " BIC CODE"), ("iban", "BE68 5390 0754 7034", "", " EUR 12"),
    ("iban", "ES91 2100 0418 4502 0005 1332", "", " UND 5"), ("iban", "SE45 5000 0000 0583 9825 7466", "", " SWIFT"), ("iban", "DE89 3704 0044 0532 0130 00", "", " BIC")])
def test_values_before_what_looks_like_a_part_of_them(kind, value, before, behind):
    new, spans = replace(before + value + behind)
    assert spans == [(kind, len(before), len(before + value))]
    assert new == before + replace(value)[0] + behind and value not in new


def test_equal_numbers_are_linked_over_formats_and_case():
    card, grouped = replace("4532015112830366")[0], replace("4532 0151 1283 0366")[0]
    assert grouped.replace(" ", "") == card
    assert replace("A.99@MAIL2.EXAMPLE.COM")[0].lower() == replace("a.99@mail2.example.com")[0]
    assert replace("2024-02-29")[0].replace("-", "")[:4] == replace("29.02.2024")[0][-4:]


def test_defined_cases(spark):
    rows = [(1, VALUES[0], 5), (1, VALUES[0], 5), (2, None, 0), (3, "", 0), (None, VALUES[3], 1), (4, "word " * 100_000 + VALUES[1], 9)]
    docs = spark.createDataFrame([(i, t, n, "s") for i, t, n in rows], "doc_id long, text string, n_chars long, spans string")
    out = replaced(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert got == {(i, None if t is None else replace(t)[0], n if t is None else len(replace(t)[0])) for i, t, n in rows}
    assert sorted(len(r.spans) for r in pseudonymised(docs).collect()) == [0, 0, 1, 1, 1, 1]
    assert replaced(docs.limit(0)).collect() == []
