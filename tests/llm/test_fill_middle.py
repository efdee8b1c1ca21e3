"""Fill-in-middle against a plain reading of the rule, over units listed one by one."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelspark.llm import fill_middle as fm
from panelspark.llm import queries
from panelspark.llm import words as W

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
ODD = ["", "a", "1", "aB", "a b", "é", "né", "日本語 text", "\U0001f600", "a\U0001f600b", "\x00", "a\x00b", "\n\n", "ab" * 4, "ab" * 4 + "é", "1234567", "12345678", "[z{@`"]


def brute(doc_id, text, markers=("<P>", "<S>", "<M>"), rate=90, spm=20, seed=1):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = markers
    if not text or any(x in text for x in markers) or h[2] % 100 >= rate:
        return n, "plain", text, None, None, None
    if h[3] % 100 < spm:
        return n, "spm", s + suffix + p + prefix + m + middle, prefix, middle, suffix
    return n, "psm", p + prefix + s + suffix + m + middle, prefix, middle, suffix


def texts(seed, n):
    rnd = random.Random(seed)
    signs = ["a", "Z", "z", "A", "0", " ", "\n", "@", "[", "`", "{", "é", "ß", "日", "\U0001f600", "<P>", "<", ">", "\x7f", "\x00"]
    return ["".join(rnd.choice(signs) * rnd.choice([1, 1, 1, 7, 8, 9]) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_every_border():
    all_texts = ODD + texts(1, 300) + ["x" * 100 + "é" * 5]
    raw, at = W.buffers(__import__("pyarrow").array(all_texts))
    units = fm.Units(raw, at)
    for i, t in enumerate(all_texts):
        listed = UNIT.findall(t)
        assert units.counts[i] == len(listed)
        ends = [0, *np.cumsum([len(u.encode()) for u in listed]).tolist()]
        got = units.border(np.full(len(ends), i), np.arange(len(ends)))
        assert got.tolist() == ends, t


def test_marks_across_runs(monkeypatch):
    text = "ab1é日" * 50
    raw, at = W.buffers(__import__("pyarrow").array([text]))
    whole = fm.Units(raw, at).marks
    monkeypatch.setattr(fm, "RUN", 3)
    assert (fm.Units(raw, at).marks == whole).all()


@pytest.mark.parametrize("markers,rate,spm,seed", [(("<P>", "<S>", "<M>"), 90, 20, 1), (("<pre>", "<suf>", "<mid>"), 100, 50, 7)])
def test_rows(spark, markers, rate, spm, seed):
    rows = [(i, t) for i, t in enumerate(ODD + texts(2, 400))] + [(None, "no id here"), (None, None), (-5, "minus five"), (3, None), (3, "again"), (3, "again")]
    rows.append((10**6, "long word é " * 200_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = fm.Markers(*markers)
    made = fm.restore(fm.transform(df, rate=rate, spm=spm, seed=seed, markers=m), markers=m).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r["n"], r["form"], r["output"], r["prefix"], r["middle"], r["suffix"]) == brute(r["doc_id"], r["text"], markers, rate, spm, seed)
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "one two three", "t", "p", 4.0), (2, None, None, None, None)], "doc_id long, text string, _text string, output string, _form double")
    made = fm.restore(fm.transform(df))
    assert made.columns == ["doc_id", "text", "_text", "_form", "n", "form", "output", "prefix", "middle", "suffix", "restored"]
    assert {(r["doc_id"], r["_text"], r["_form"], r["output"]) for r in made.collect()} == {(1, "t", 4.0, brute(1, "one two three")[2]), (2, None, None, "")}
    assert fm.restore(fm.transform(df.limit(0))).count() == 0


def test_markers_must_be_clear():
    for bad in (("<P>", "<P>", "<M>"), ("<<P>", "<S>", "<M>"), ("P", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fm.Markers(*bad)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12(spark, sf).collect()
    assert len(got) == len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, form, output, prefix, middle, _ = brute(r["doc_id"], text[r["doc_id"]])
        chars = (None, None) if form == "plain" else (len(prefix), len(middle))
        want = (n, form, *chars, sha(output), sha(text[r["doc_id"]] or ""))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == want
