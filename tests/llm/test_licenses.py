"""op12: the query against SQL, templates against their regular expressions, odd rows."""

from __future__ import annotations

import random
import re

import pytest

from tests.compare import check
from tidemark.llm import license_templates as lt
from tidemark.llm.catalog import ORACLES, QUERIES


def test_query_matches_sql(spark, sf, duck):
    check(QUERIES["op12_license_templates"](spark, sf), duck.sql(ORACLES["op12_license_templates"]))


def labels_of(scanner, text):
    import pyarrow as pa

    (row,) = scanner.scan(pa.array([text.encode()]))
    return row


def spelled(items, rng, keep):
    """Words that the template accepts; optional regions stay with this chance."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(item)
        elif item[0] == "any":
            out += [rng.choice(["acme", "inc", "the", "software", "2024", "süd"]) for _ in range(rng.randint(item[1], item[2]))]
        elif item[0] == "or":
            out += rng.choice(item[1])
        elif rng.random() < keep:
            out += spelled(item[1], rng, keep)
    return out


@pytest.fixture(scope="module")
def scanner():
    return lt.Scanner(lt.TEMPLATES, lt.PHRASES)


@pytest.mark.parametrize("k", range(len(lt.TEMPLATES)))
def test_every_template(scanner, k):
    label, template = lt.TEMPLATES[k]
    items = lt.parse(template)
    for seed in range(6):
        rng = random.Random(seed)
        words = spelled(items, rng, (0, 0.5, 1)[seed % 3])
        marks = [rng.choice([" ", "\n", ", ", " (", '"; ']) for _ in words]
        text = "Vorwort und dies. " + "".join(rng.choice([w, w.upper(), w.title()]) + m if w.isascii() else w + m for w, m in zip(words, marks)) + " -- the end"
        found = labels_of(scanner, text)
        assert (label, 3, len(words)) in [(m[0], m[1], m[2]) for m in found[5]], text
        must = [i for i, w in enumerate(words) if isinstance(w, str)]
        line = " ".join(["", *words, ""])
        assert re.search(" " + lt.regex(items), line)
        # one word of the wording changed: the automaton and the regular expression agree
        at = rng.choice(must)
        broken = [*words[:at], "zzz", *words[at + 1 :]]
        hit = any(m[0] == label and m[1] == 0 and lt.regex(items) and re.match(lt.regex(items), "".join(w + " " for w in broken)) for m in labels_of(scanner, " ".join(broken))[5])
        assert hit == bool(re.match(lt.regex(items), "".join(w + " " for w in broken)))


def test_mandatory_wording(scanner):
    full = next(t for label, t in lt.TEMPLATES if label == "mit" and "Permission" in t)
    text = " ".join(spelled(lt.parse(full), random.Random(1), 1))
    assert {m[0] for m in labels_of(scanner, text)[5]} == {"mit"}
    assert not labels_of(scanner, text.replace("without restriction", "with restriction"))[5]
    assert not labels_of(scanner, text.replace("merge publish", "merge and publish"))[5]
    assert not labels_of(scanner, text.rsplit(" ", 1)[0])[5]
    assert not labels_of(scanner, " ".join(spelled(lt.parse(full), random.Random(1), 1)).replace("acme", "acme " * 41))[5]


def test_phrases_cross_no_text_and_repeat(spark):
    rows = [(1, "under the"), (1, "MIT license"), (2, "under the MIT-license; UNDER THE mit, License"), (3, "cc by nc by nc cc by nc"), (4, "under the mit licenseé")]
    found = {(r.doc_id, r.license.n_words): r.license for r in lt.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ["doc_id"]).collect()}
    assert found[1, 2].n_base == 0 and found[2, 8].n_base == 2 and (found[2, 8].first_word, found[2, 8].last_word) == (0, 4)
    assert found[3, 8].n_base == 2 and found[3, 8].base_labels == ["cc-by-nc"] and found[4, 4].n_base == 0
    assert found[1, 2].first_word is None


def test_long_text_in_parts(monkeypatch, scanner):
    text = "word " * 5000 + "released under the mit license " + "other, " * 3000 + "apache license version 2 0"
    whole = labels_of(scanner, text)
    real = lt.in_parts
    monkeypatch.setattr(lt, "in_parts", lambda texts, blanks: real(texts, blanks, 997))
    assert labels_of(scanner, text) == whole
    assert whole[:4] == (8010, 2, 5001, 8005)


def test_odd_rows(spark, odd_docs, no_docs):
    found = lt.scan(odd_docs, odd_docs.columns)
    assert found.columns == [*odd_docs.columns, "license"]
    rows = {(r.doc_id, r.text): r for r in found.collect()}
    assert found.count() == odd_docs.count()
    assert rows[2, None].license.n_words == 0 and rows[3, ""].license.n_base == 0 and rows[2, None].license.matches == []
    assert lt.scan(no_docs, ["doc_id"]).count() == 0
    clash = odd_docs.withColumnRenamed("found", "license").withColumnRenamed("tail", "text0")
    assert lt.scan(clash, ["doc_id", "license", "text0"], into="result").count() == odd_docs.count()
    with pytest.raises(ValueError):
        lt.scan(clash, ["license"])


@pytest.mark.parametrize("bad", ["a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>> b <<endOptional>>", '<<var;match=".{0,3}">>'])
def test_faulty_templates(spark, bad):
    with pytest.raises(ValueError):
        lt.Automaton((("x", bad),))
