"""Fill-in-the-middle transformation: texts cut at two random unit ends and put in another order.

One Aho-Corasick automaton runs over a text. Its patterns are the ASCII characters at which the class of a
unit changes (line feeds for lines, white space for words, none for characters) and the sentinels. Between
two events nothing changes, so units are counted by arithmetic on the events' places: a unit ends behind a
character of the class that no other follows, and what is left at the end of the text is one more unit; a character
is a unit by its place alone. The end of the k-th unit is found by rank among those ends, no list
of units is made.

Layouts: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` the text
itself, for empty texts, texts that hold a sentinel, and those left out by ``rate``. Sentinels can't overlap
each other, so the automaton finds in a layout just those that were put there, and it reads back to
the exact text.

All draws come from the SHA-256 of the seed and the identifier, so a rerun or a lost task gives the same rows. Rows are
transformed where they are, without a shuffle, each whole and by itself.

Defined results: a null text is empty, has no units and is plain; a null identifier is drawn as the empty
text; repeated rows get the same draws; a very long text is held in one task, whole; columns named as those of
the result give way to them, others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried, where

PLAIN, PSM, SPM = "plain", "psm", "spm"

#: The characters that end a unit, by kind; those of a run end one unit together if the kind is in RUNS.
CLASSES = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
RUNS = ("word",)

#: Text columns of a result, and its numbers.
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Layout:
    """Sentinels for prefix, suffix and middle, and the kind of unit: line, word or char."""

    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    unit: str = "line"

    def __post_init__(self):
        if self.unit not in CLASSES:
            raise ValueError(f"unit is one of {', '.join(CLASSES)}")
        for a in self.sentinels:
            if len(a) < 2:
                raise ValueError("a sentinel has two characters at least")
            for b in self.sentinels:
                if any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and a in b):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")
        if len(set(self.sentinels)) < 3:
            raise ValueError("the three sentinels differ")

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, s in enumerate(self.sentinels):
            found.add_word(s, i)
        for c in CLASSES[self.unit]:
            found.add_word(c, -1)
        found.make_automaton()
        return found

    def scan(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ends of the units that a class character ends, and (end, which) of the sentinels."""
        ends, marks = [], []
        for at, kind in self.automaton.iter(text):
            if kind < 0:
                ends.append(at + 1)
            else:
                marks.append((at + 1, kind))
        if self.unit in RUNS and ends:
            places = np.array(ends)
            ends = places[np.append(places[1:] != places[:-1] + 1, True)].tolist()
        return ends, marks

    def units(self, text: str, ends: list[int]) -> int:
        """How many units the text has."""
        if self.unit == "char":
            return len(text)
        return len(ends) + (len(text) > (ends[-1] if ends else 0))

    def end_of(self, k: int, text: str, ends: list[int]) -> int:
        """Where the first ``k`` units end."""
        if self.unit == "char":
            return k
        return 0 if k == 0 else ends[k - 1] if k <= len(ends) else len(text)

    def lay_out(self, text: str, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, characters of the prefix, of the middle, output) of a text."""
        ends, marks = self.scan(text)
        n = self.units(text, ends)
        if not text or marks or draws[2] % 100 >= rate:
            return n, PLAIN, None, None, text
        low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
        a, b = self.end_of(low, text, ends), self.end_of(high, text, ends)
        p, s, m = self.sentinels
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if draws[3] % 100 < spm_rate:
            return n, SPM, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, PSM, a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def read_back(self, output: str, form: str) -> str:
        """The text of an output."""
        if form == PLAIN:
            return output
        marks = [(end - len(self.sentinels[kind]), end, kind) for end, kind in self.scan(output)[1]]
        if len(marks) != 3:
            raise ValueError(f"an output of the form {form} has {len(marks)} sentinels")
        starts = [begin for begin, _, _ in marks[1:]] + [len(output)]
        part = {kind: output[end:stop] for (_, end, kind), stop in zip(marks, starts)}
        return part[0] + part[2] + part[1]


def transform(docs: DataFrame, layout: Layout = Layout(), seed: int = 7, rate: int = 100, spm_rate: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    ``rate``: percent of texts that are laid out; ``spm_rate``: percent of those in the form spm.
    """
    names = [c.split()[0] for c in MADE.split(", ")]
    safe, kept = carried(docs, *names)
    columns, own = [s for s, _ in kept], f"c{where(docs, text)}"
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"c{where(docs, key)}").cast("string"), F.lit(""))), 256)
    rows = safe.select(*columns, F.coalesce(F.col(own), F.lit("")).alias("body"), F.unhex(F.substring(drawn, 1, 32)).alias("draws"))

    def run(batches):
        for b in batches:
            out = []
            for body, draws in zip(b.column("body"), b.column("draws")):
                four = np.frombuffer(draws.as_py(), dtype=">u4").tolist()
                out.append(layout.lay_out(body.as_py(), four, rate, spm_rate))
            made = list(zip(*out)) or [()] * len(names)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(x, t) for x, t in zip(made, types))], [*columns, *names])

    schema = T.StructType([*rows.select(*columns).schema, *T.StructType.fromDDL(MADE)])
    return rows.mapInArrow(run, schema).toDF(*(g for _, g in kept), *names)


def restore(rows: DataFrame, layout: Layout = Layout(), output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with ``restored``, the text read back from output and form alone."""
    safe, kept = carried(rows, "restored")
    columns, o, f = [s for s, _ in kept], f"c{where(rows, output)}", f"c{where(rows, form)}"

    def run(batches):
        for b in batches:
            texts = [layout.read_back(x.as_py(), k.as_py()) for x, k in zip(b.column(o), b.column(f))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "restored"])

    schema = T.StructType([*safe.select(*columns).schema, T.StructField("restored", T.StringType())])
    return safe.select(*columns).mapInArrow(run, schema).toDF(*(g for _, g in kept), "restored")
