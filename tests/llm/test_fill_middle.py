"""Fill-in-the-middle against lists of units, and back to the texts."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import fill_middle as M

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}


def brute(key, text, unit, seed=7, rate=100, spm_rate=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    parts = ["a", "é", "\n", "\n\n", " ", "\t", "\x0b", "\x1c", "\r\n", "<", "<S", "<P", "P>", "😀", "word", "\u2028"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    out += [(500, None), (501, ""), (502, "\n"), (503, "no end"), (504, "a<P>b\n"), (505, "x\n<M>"), (506, "line\n" * 60_000), (507, "z" * 300_000), (None, "a\nb\nc"), (503, "no end"), (-9, "q\nr\n")]
    return out


@pytest.mark.parametrize("unit, rate, spm_rate", [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_same_as_lists(spark, rows, unit, rate, spm_rate):
    docs = spark.createDataFrame([(i, t, "o", 1.5) for i, t in rows], "doc_id long, text string, `a.b` string, Form double")
    layout = M.Layout(unit=unit)
    made = M.restore(M.transform(docs, layout, rate=rate, spm_rate=spm_rate), layout)
    assert made.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = made.collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        assert tuple(r)[3:8] == brute(r["doc_id"], r["text"], unit, 7, rate, spm_rate)
        assert r["restored"] == (r["text"] or "")
        seen.add(r["form"])
    assert "plain" in seen and len(seen) >= 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.restore(M.transform(docs)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>SPM\nab \t", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(["line", "word", "char"]), st.integers(0, 1))
def test_round_trip(text, h1, h2, unit, form):
    layout = M.Layout(unit=unit)
    n, kind, a, b, output = layout.lay_out(text, (h1, h2, 0, form), 100, 1)
    assert n == len(re.findall(UNITS[unit], text))
    assert layout.read_back(output, kind) == text
    assert kind == "plain" or (0 <= a <= len(text) and 0 <= b <= len(text) - a)


def test_sentinels_must_not_overlap():
    for bad in (("<P>", "<P>", "<M>"), ("<P><", "<S>", "<M>"), ("<P>", "a<P>b", "<M>"), ("P", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.Layout(bad)
    with pytest.raises(ValueError):
        M.Layout(unit="page")
