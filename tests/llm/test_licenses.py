"""License scan against plain searches: base places, spans by edits at every place."""

import random
import re

import pytest

from solera.llm import licenses as li
from solera.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def base(text):
    w, found = words(text), []
    for label, phrase in li.PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def shown(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_places_of_the_query(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op12_license_scan"](spark, SF01).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    assert all(shown(r) == base(text[r["doc_id"]]) for r in rows)
    for r in rows:
        # the one notice that no phrase stands for, and no others in clean documents
        w = " ".join(words(text[r["doc_id"]]))
        assert ("gpl-3" in r["labels"].split(",")) == ("gnu general public license version 3" in w)
        assert bool(r["labels"]) == (r["score"] > 0) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5, "y") for i, t in rows], "doc_id long, text string, n_words int, id string, score double, words string")


def test_odd_rows_and_empty_tables(spark):
    many = "cc by nc " * 3000 + "İK under the MİT license under the mit license"
    rows = [(1, "Under the MIT-License!"), (1, "Under the MIT-License!"), (1, "cc by nc by nc"), (2, None), (3, ""), (4, " \n -- "), (None, "CC BY-NC cc,by,nc"), (None, None),
            (5, many), (6, "x" * 50000), (7, "apache license version 2apache license version 2"), (8, "cc by cc by nc"), (9, "KC BY NC é cc by nc")]
    got = li.scanned(frame(spark, rows)).collect()
    key = lambda x: (str(x[0]), *map(str, x[1]))
    assert sorted(((r["doc_id"], shown(r)) for r in got), key=key) == sorted(((i, base(t)) for i, t in rows), key=key)
    assert li.scanned(frame(spark, rows).filter("false")).count() == 0


def test_changed_notices_and_look_alikes(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], []
    for k, (label, text) in enumerate(li.NOTICES):
        w = words(text)
        for edits in range(li.edits_allowed(len(w)) + 1):
            v = list(w)
            # one change in each stretch: enough grams are left whole for the votes
            for e in range(edits):
                at = len(v) * (2 * e + 1) // (2 * edits)
                rng.choice((lambda: v.pop(at), lambda: v.insert(at, "zzz"), lambda: v.__setitem__(at, "zzz")))()
            rows.append((len(rows), f"{filler(rng.randrange(30))} {' '.join(v)} {filler(rng.randrange(30))}"))
            want.append((label, edits, len(w)))
    got = li.scanned(frame(spark, rows)).orderBy("doc_id").collect()
    for r, (label, edits, n) in zip(got, want, strict=True):
        if edits == 0:
            assert r["labels"] == label or label in r["labels"].split(",") and r["score"] == 1.0, (r, label)
        if n - li.GRAM + 1 - li.GRAM * edits >= 1:
            assert r["labels"], (r, label, edits, n)
    for text, label in (("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
                        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"), ("licensed under cc by sa 4.0", "cc-by-sa")):
        assert li.scanned(frame(spark, [(1, text)])).first()["labels"] == label


def test_least_edits_against_all_runs():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            new = [n]
            for m, y in enumerate(b, 1):
                new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        own, along = ([rng.choice("abc") for _ in range(rng.randrange(lo, 8))] for lo in (1, 0))
        edits, first, stop = li.least_edits(own, along)
        runs = [(distance(own, along[i:j]), i, j) for i in range(len(along) + 1) for j in range(i, len(along) + 1)]
        assert edits == min(runs)[0] and (edits, first, stop) in runs


def test_a_template_needs_a_gram(spark):
    with pytest.raises(ValueError):
        li.scanned(frame(spark, [(1, "a")]), notices=[("x", "two words")])
