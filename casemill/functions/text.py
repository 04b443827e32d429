"""Text: normal form, templates, similarity, masking."""

from __future__ import annotations

import hashlib
import math
import re
import textwrap
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions.arrays import bound, running_sum

#: Letters of a token, without vowels and look-alikes, and how many there are.
ALPHABET = "BCDFGHJKMNPQRSTVWXZ23456789"
TOKEN_LENGTH = 12
PLACEHOLDER = rf"\[\[PII\|[A-Z]+\|[{ALPHABET}]{{{TOKEN_LENGTH}}}\]\]"
#: Fixed value: the syntax of what only looks like a placeholder, too.
SHAPED = r"\[\[\s*PII\s*\|[^\]]{0,64}\]\]"
#: All white space, of any script, and the separators of information.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Characters that end a line, of any script.
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Stands around matches in a scanned copy; where the text has it, the copy has the other one.
MARK, OTHER = "\x01", "\x02"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(~text.rlike(f"[^\\p{{IsWhite_Space}}\\x1c-\\x1f]"), F.lit(True))


def normal_text(text: Column) -> Column:
    """Line-break hyphens between letters go, white space becomes one space, ends are trimmed."""
    joined = F.regexp_replace(text, rf"(?<=\p{{L}})-(?={SPACE}*[{BREAKS}]){SPACE}+(?=\p{{L}})", "")
    return stripped(F.regexp_replace(joined, f"{SPACE}+", " "))


def folded_words(text: Column) -> Column:
    """Case folded, with single spaces between words."""
    return F.replace(F.lower(stripped(F.regexp_replace(text, f"{SPACE}+", " "))), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC; no native function has it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by values; unknown names stay, null values become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def pieces(text: Column, pattern: str) -> Column:
    """``text`` cut around all matches: text, match, text, ..., text.  A pattern can't match the two control characters."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in order; offsets in code points; empty for null."""

    def placed(cut: Column) -> Column:
        ends = running_sum(F.transform(cut, lambda x: F.length(x)))
        found = F.transform(F.arrays_zip(cut.alias("value"), ends.alias("end")), lambda x, i: F.when(i % 2 == 1, F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
        return F.filter(found, lambda x: x.isNotNull())

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), bound(pieces(text, pattern), placed)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def masked(text: Column, pattern: str = PLACEHOLDER) -> Column:
    """Every match blanked, at its place, by spaces of the same length, so that offsets stay."""
    blank = F.transform(pieces(text, pattern), lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return F.when(text.rlike(pattern), F.array_join(blank, "")).otherwise(text)


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|): similarity in which a substitution costs two."""
    if not a and not b:
        return 1.0
    if len(b) > len(a):
        a, b = b, a
    # Bit-parallel longest common subsequence: one big integer for the shorter text.
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(b)) - 1
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(b) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(needle: str, stack: str) -> float:
    """The best Indel similarity of the shorter text to a part of the longer one that is as long at most."""
    if len(needle) > len(stack):
        needle, stack = stack, needle
    n = len(needle)
    if not n:
        return 1.0 if not stack else 0.0
    parts = {stack[max(0, i) : i + n] for i in range(1 - n, len(stack))}
    return max(indel_ratio(needle, p) for p in parts)


@F.pandas_udf(T.DoubleType())
def partial_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def is_placeholder(text: Column) -> Column:
    """Whether the text is one placeholder and nothing else."""
    return F.coalesce(text.rlike(f"^{PLACEHOLDER}$"), F.lit(False))


def tidy(text: Column) -> Column:
    """Without blanks at line ends, and with one empty line between paragraphs at most."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\r?\n|$)", ""), r"(\r?\n){3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def wrapped(text: pd.Series) -> pd.Series:
    """Lines of 76 characters at most, broken at spaces; paragraphs stay apart."""
    fill = lambda p: textwrap.fill(p, 76, break_long_words=False, break_on_hyphens=False)
    return text.map(lambda x: None if x is None else "\n".join(fill(p) for p in x.split("\n")))


def short_label(label: Column) -> Column:
    """A label up to the first bracket or full stop."""
    return stripped(F.regexp_replace(label, r"(?s)[(.].*$", ""))


def address_lines(parts: Mapping[str, Column], groups: Sequence[Sequence[str]]) -> Column:
    """Lines of an address: each group's parts that are not blank, joined by a space; empty lines are left out."""
    line = lambda g: F.nullif(F.concat_ws(" ", *[F.when(~is_blank(parts[k]), stripped(parts[k])) for k in g]), F.lit(""))
    return F.concat_ws("\n", *[line(g) for g in groups])


SEGMENTS = T.StructType().add("text", T.StringType()).add("starts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType()))
_CLUSTER = re.compile(r"(?s).[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]*")


def normalized(raw: str) -> tuple[str, list[int], list[int]]:
    """Normal text, composed cluster by cluster, and for each of its characters the part of ``raw`` that it stands for."""
    clusters = [(m.start(), m.end(), unicodedata.normalize("NFC", m[0])) for m in _CLUSTER.finditer(raw)]
    out, starts, ends, i, n = [], [], [], 0, len(clusters)
    while i < n:
        start, end, text = clusters[i]
        j = i + 1
        if text == "-" and i and clusters[i - 1][2][-1:].isalpha():
            while j < n and clusters[j][2].isspace():
                j += 1
            gap = raw[end : clusters[j - 1][1]]
            if j < n and any(c in BREAKS for c in gap) and clusters[j][2][:1].isalpha():
                i = j
                continue
            j = i + 1
        if text.isspace():
            while j < n and clusters[j][2].isspace():
                j += 1
            end, text = clusters[j - 1][1], " "
            if not out or j == n:
                i = j
                continue
        for c in text:
            out.append(c)
            starts.append(start)
            ends.append(end)
        i = j
    return "".join(out), starts, ends


#: Texts whose normal form and way back a Python worker holds at once; an Arrow batch may have many more.
PIECE = 200


@F.pandas_udf(SEGMENTS)
def normal_text_map(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Normal text with its way back; composition has no native function, and offsets need one walk over the text.

    Offsets of a piece of texts are handed on before those of the next one are made.
    """
    places = lambda xs: np.array(xs, np.int32)

    def one(raw: str | None) -> tuple:
        text, starts, ends = (None, None, None) if raw is None else normalized(raw)
        return (text, None, None) if text is None else (text, places(starts), places(ends))

    for batch in texts:
        for at in range(0, len(batch), PIECE):
            yield pd.DataFrame([one(x) for x in batch.iloc[at : at + PIECE]], columns=["text", "starts", "ends"])


def raw_span(segments: Column, start: Column, end: Column) -> Column:
    """The part of the raw text for the part [start, end) of the normal text, widened to whole runs; null if it is empty or outside."""
    first, last = F.get(segments["starts"], start), F.get(segments["ends"], end - 1)
    return F.when((start >= 0) & (start < end) & last.isNotNull(), F.struct(first.alias("start"), last.alias("end")))


def _embedded(text: str, dim: int) -> list[float]:
    out = [0.0] * dim
    told = " " + " ".join(text.split()).casefold() + " "
    for n in (3, 4, 5):
        for i in range(len(told) - n + 1):
            h = int.from_bytes(hashlib.blake2b(told[i : i + n].encode(), digest_size=8).digest(), "big")
            out[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    """96 signed counts of hashed character n-grams (3 to 5), of norm 1; zeros for blank text."""
    return text.map(lambda x: None if x is None else _embedded(x, 96) if x.strip() else [0.0] * 96)
