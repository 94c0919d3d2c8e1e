"""Validating quotes against the texts they cite: verbatim, or else with formatting folded out, with spans in the original text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIONS = 3  # of an ambiguous quote, reported at most
# Characters written as another, and what a match is trimmed of.
FOLDED = str.maketrans({"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"})
OUTER = " \t\n.,;:!?\"'"
_MARKS = re.compile(
    r"""(?P<drop>\\(?=[!-/:-@\[-`{-~]) | \*+ | _+ | ~~ | ` | \[(?=[^\[\]\n]*\]\([^()\n]*\)) | \]\([^()\n]*\))
    | (?P<money>\$\((?=\d)(?P<a>[^()\n]*)\) | \(\$(?=\d)(?P<b>[^()\n]*)\))
    | (?P<space>[\s|]+)""",
    re.VERBOSE,
)


def compatible(text: str) -> tuple[str, np.ndarray]:
    """NFKC of each character, and which character of the text each one of the result comes from."""
    if text.isascii():
        return text, np.arange(len(text))
    parts = [unicodedata.normalize("NFKC", c) for c in text]
    return "".join(parts), np.repeat(np.arange(len(text)), [len(p) for p in parts])


def folded(text: str) -> tuple[str, np.ndarray]:
    """The text without formatting, and for each of its characters the place in the original.

    Compatibility forms, quotes and dashes are unified, markdown escapes, emphasis, code marks and links go (the label stays),
    ``$(1,234)`` and ``($1,234)`` become ``$1,234``, runs of white space and table bars become one space, and all is in lower case.
    """
    plain, origin = compatible(text)
    pieces: list[str] = []
    places: list[np.ndarray] = []

    def emit(a: int, b: int) -> None:
        if a < b:
            part = plain[a:b].translate(FOLDED)
            low = part.lower()
            spots = origin[a:b]
            if len(low) != len(part):  # some letters have longer lower-case forms
                grown = [c.lower() for c in part]
                low, spots = "".join(grown), np.repeat(spots, [len(c) for c in grown])
            pieces.append(low)
            places.append(spots)

    at = 0
    for m in _MARKS.finditer(plain):
        emit(at, m.start())
        at = m.end()
        if m["space"]:
            pieces.append(" ")
            places.append(origin[m.start() : m.start() + 1])
        elif m["money"]:
            sign = plain.index("$", m.start())
            emit(sign, sign + 1)
            emit(*m.span("a" if m["a"] is not None else "b"))
    emit(at, len(plain))
    return "".join(pieces), np.concatenate(places) if places else np.zeros(0, np.int64)


def starts_of(text: str, quote: str, limit: int) -> list[int]:
    """Where the quote stands, overlapping places too, one more than ``limit`` at most."""
    out: list[int] = []
    at = text.find(quote) if quote else -1
    while at >= 0 and len(out) <= limit:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


def validate(text: str | None, quote: str | None) -> tuple[str, int | None, int | None, list[int], bool]:
    """Verdict, start, end, positions and whether there are more of them.

    verbatim or normalised (the one place, as a span of the original), ambiguous (the first ``POSITIONS`` places), or absent. A null or
    empty quote, one of formatting alone, and a null text are absent.
    """
    text, quote = text or "", quote or ""
    found = starts_of(text, quote, POSITIONS)
    if len(found) == 1:
        return "verbatim", found[0], found[0] + len(quote), found, False
    if not found:
        needle = folded(quote)[0].strip(OUTER)
        plain, origin = folded(text) if needle else ("", np.zeros(0, np.int64))
        spots = starts_of(plain, needle, POSITIONS)
        if not spots:
            return "absent", None, None, [], False
        found = [int(origin[s]) for s in spots]
        if len(found) == 1:
            return "normalised", found[0], int(origin[spots[0] + len(needle) - 1]) + 1, found, False
    return "ambiguous", None, None, found[:POSITIONS], len(found) > POSITIONS


def validate_citations(citations: DataFrame, texts: DataFrame, key: str, cited: str, quote: str, text: str) -> DataFrame:
    """``key, verdict, start, end, positions, more`` of citations (``key, cited, quote``) against the text that each cites.

    A citation of an unknown text is absent. Each citation meets its one text: an equi-join.
    """
    kind = citations.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [validate(t, q) for q, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=[key, "verdict", "start", "end", "positions", "more"])

    asked = citations.select(F.col(key).alias("_key"), F.col(cited).alias("_cited"), F.col(quote).alias("_quote"))
    met = asked.join(texts.select(F.col(cited).alias("_cited"), F.col(text).alias("_text")), "_cited", "left").select("_key", "_quote", "_text")
    return met.mapInArrow(run, f"{key} {kind}, verdict string, start int, end int, positions array<int>, more boolean")
