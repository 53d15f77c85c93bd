"""License scans by conditional compression: a block that a license's wording makes short is that license."""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.license_texts import TEMPLATES

#: Between the words of a term: white space and what comments put at line ends and beginnings.
_GAP = r"[\s*#/;>-]+"
# A text without any of these holds no notice.
TERMS = r"(?i)licen[sc]|copyright|creative_commons|creativecommons|public_domain|permission_(?:is_hereby|to_use)|redistribution_and_use|free_software|free_to_copy|permitted_to_copy|without_any_express|all_copies|as_is\b|\bcc[ -]?(?:by|0)\b|spdx".replace("_", _GAP)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_SPDX = re.compile(r"(?i:spdx-license-identifier):[ \t]*([A-Za-z0-9.+() \t-]+)")
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Wording(NamedTuple):
    """A license's wording, its words, at which of them its terms begin, and a compressor that has it as raw dictionary."""

    license: str
    text: str
    words: list[str]
    distinct: frozenset
    anchors: list[int]
    compressor: zstandard.ZstdCompressor


@lru_cache(maxsize=4)
def _wordings(templates: tuple, level: int = 19) -> tuple[list[Wording], zstandard.ZstdCompressor]:
    """All wordings, and a plain compressor."""
    out = []
    for name, texts in templates:
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            starts = [m.start() for m in _WORD.finditer(text)]
            at = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(TERMS, text)}) or [0]
            out.append(Wording(name, text, words(text), frozenset(words(text)), at, zstandard.ZstdCompressor(level=level, dict_data=raw, write_checksum=False, write_content_size=False)))
    return out, zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)


def wording_difference(block: list[str], wording: list[str]) -> tuple[list[str], list[str]]:
    """(words of the wording that the block lacks, words of the block put in between), by exact alignment.

    Words before the first and after the last aligned word are context, not difference.
    """
    steps = difflib.SequenceMatcher(None, block, wording, autojunk=False).get_opcodes()
    same = [i for i, s in enumerate(steps) if s[0] == "equal"]
    if not same:
        return wording, []
    missing = [w for tag, _, _, a, b in steps if tag in ("insert", "replace") for w in wording[a:b]]
    extra = [w for i, (tag, a, b, _, _) in enumerate(steps) if tag in ("delete", "replace") and same[0] < i < same[-1] for w in block[a:b]]
    return missing, extra


def _spdx(text: str, templates: tuple) -> list[tuple[int, int, dict]]:
    """(start, end, notice) of every identifier of every SPDX line; an explicit tag needs no wording."""
    _, plain = _wordings(templates)
    found = []
    for line in _SPDX.finditer(text):
        for m in _SPDX_ID.finditer(text, line.start(1), line.end(1)):
            if m[0] in ("AND", "OR", "WITH"):
                continue
            wording = f"SPDX-License-Identifier: {m[0]}"
            raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            small = zstandard.ZstdCompressor(level=19, dict_data=raw, write_checksum=False, write_content_size=False).compress(wording.encode())
            hit = {"block": line[0], "license": m[0], "reduction": round(1 - len(small) / len(plain.compress(wording.encode())), 6), "difference": 0.0, "missing": [], "extra": [], "wording": wording}
            found.append((line.start(), line.end(), hit))
    return found


def notices_within(text: str, templates: tuple, least_reduction: float, most_difference: float) -> list[tuple[int, int, dict]]:
    """(start, end, notice) wherever in a text, in order: lines, inside longer ones, or wrapped over any number of them.

    A term of the text stands for each equal place of each wording; the candidate block is the words around it, as
    many as the wording with the difference allowed can have. Blocks are compressed with each wording whose words they hold; those
    that shrink enough, largest reduction first, are aligned with it word by word. Of those with a small enough difference that touches
    no number, the wording that accounts for most words wins. The reduction returned is that of what the wording covers.
    """
    found = _spdx(text, templates)
    tagged = [(start, end) for start, end, _ in found]
    spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    starts = [s[0] for s in spans]
    wordings, plain = _wordings(templates)
    reach = max((len(w.words) for w in wordings), default=0)
    reach += math.floor(most_difference * reach) + 1
    after = 0
    for hit in re.finditer(TERMS, text):
        if hit.start() < after or not spans or any(a <= hit.start() < b for a, b in tagged):
            continue
        j = max(0, bisect_right(starts, hit.start()) - 1)
        around = {s[2] for s in spans[max(0, j - reach) : j + reach]}
        free = bisect_right(starts, after - 1)
        ranked = []
        for w in wordings:
            if len(w.distinct - around) > most_difference * len(w.words):
                continue
            slack = math.floor(most_difference * len(w.words)) + 1
            for o in w.anchors:
                lo, hi = max(free, j - o - slack), j - o + len(w.words) + slack
                block = [s[2] for s in spans[lo : max(lo, hi)]]
                have = set(block)
                if sum(x in have for x in w.words) < (1 - most_difference) * len(w.words) - 1e-9:
                    continue
                raw = text[spans[lo][0] : spans[lo + len(block) - 1][1]].encode()
                gain = 1 - len(w.compressor.compress(raw)) / len(plain.compress(raw))
                if gain >= least_reduction / 2:  # it holds words around the notice too
                    ranked.append((gain, w, lo, block))
        best = None
        for _, w, lo, block in sorted(ranked, key=lambda r: (-r[0], r[1].license, r[1].text)):
            missing, extra = wording_difference(block, w.words)
            share = (len(missing) + len(extra)) / len(w.words)
            if share > most_difference or any(c.isdigit() for x in missing for c in x):
                continue
            same = [s for s in difflib.SequenceMatcher(None, block, w.words, autojunk=False).get_matching_blocks() if s.size]
            start, end = spans[lo + same[0].a][0], spans[lo + same[-1].a + same[-1].size - 1][1]
            if not start <= hit.start() < end:
                continue
            if text[end : end + 1] == w.text[-1]:
                end += 1  # its full stop
            raw = " ".join(text[start:end].split("\n"))
            gain = 1 - len(w.compressor.compress(raw.encode())) / len(plain.compress(raw.encode()))
            key = (-len(w.words) * (1 - share), share, w.license, w.text)
            if gain >= least_reduction and (best is None or key < best[0]):
                best = (key, start, end, {"block": raw, "license": w.license, "reduction": round(gain, 6), "difference": round(share, 6), "missing": missing, "extra": extra, "wording": w.text})
        if best:
            found.append(best[1:])
            after = best[2]
    return sorted(found, key=lambda f: f[:2])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least_reduction: float = 0.3, most_difference: float = 0.15) -> DataFrame:
    """One row per confirmed license notice: doc_id, block_no, block, license, reduction, difference, missing, extra, wording.

    ``block`` is what the wording covers, with line feeds as blanks; ``block_no`` is the number of the line in which it
    begins, from 0. Texts without any term never leave the JVM; of the others the whole text is read.

    Edge cases: null and empty texts have no notice; a very long text is gone through term by term, each with a window of the
    longest wording's size; repeated rows each give their rows; an empty table gives no row; other columns are ignored.
    """
    fixed = tuple((k, tuple(v)) for k, v in sorted(templates.items()))
    schema = "doc_id long, block_no long, block string, license string, reduction double, difference double, missing array<string>, extra array<string>, wording string"

    text = pa.string()
    out = pa.schema([("doc_id", pa.int64()), ("block_no", pa.int64()), ("block", text), ("license", text), ("reduction", pa.float64()), ("difference", pa.float64()), ("missing", pa.list_(text)), ("extra", pa.list_(text)), ("wording", text)])

    def scan(batches):
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                breaks = [m.start() for m in re.finditer("\n", text)]
                found += [{"doc_id": doc_id, "block_no": bisect_right(breaks, start), **hit} for start, _, hit in notices_within(text, fixed, least_reduction, most_difference)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=out)

    candidates = docs.where(F.col("text").rlike(TERMS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return candidates.mapInArrow(scan, schema)


def license_summary(notices: DataFrame) -> DataFrame:
    """Documents and notices by license."""
    return notices.groupBy("license").agg(F.count("*").alias("n_notices"), F.countDistinct("doc_id").alias("n_docs"))
