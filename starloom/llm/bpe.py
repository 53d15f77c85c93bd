"""Byte-pair encoding and decoding as streaming transducers of constant memory.

Encoding reads a word symbol by symbol and emits a token as soon as no later symbol can change it. How
many symbols that takes, the sufficient lookahead, is computed from the merge list. Decoding is a state
machine from token bytes to text that keeps at most one unfinished character.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.workers import released

#: Bytes of words, and again of their parts, that a task remembers with their ids before it starts afresh.
MEMO_BYTES = 64 << 20
#: Bytes of text that are read at a time; words longer than LONG go through in pieces and are not remembered.
SLICE, LONG, PIECE = 1 << 20, 2048, 4096
#: Symbols up to which a plain search for the next merge beats a queue.
SHORT = 64
#: Bytes of results that leave a task at a time.
OUT_BYTES = 8 << 20
SCHEMA = "doc_id long, ids binary, decoded string"
_NONE = 1 << 62  # no merge: above every rank
_WHITE = re.compile(rb"[\x09-\x0D\x20]")
_LATIN = re.compile("[\x00-\u017f]*").fullmatch


class Merges:
    """A merge list, its byte symbols and its sufficient lookahead."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.symbols = [vocab[c] for c in alphabet]
        self.lasts = [vocab[c + suffix] for c in alphabet]  # a word's last byte
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks: dict[int, int] = {}  # a pair of tokens to its rank (from 1) and the token it makes
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if made.get(left, -1) >= rank or made.get(right, -1) >= rank:
                raise ValueError("a merge comes before those that make its parts")
            made[new] = rank
            self.ranks[left << 32 | right] = (rank + 1) << 32 | new
        parts = {vocab[x] for pair in pairs for x in pair}
        first_use = {}
        for rank, pair in enumerate(pairs):
            for x in pair:
                first_use.setdefault(vocab[x], rank)
        if any(first_use[t] <= made[t] for t in parts if t in made):
            raise ValueError("a merge list that uses a token before all its merges are known")
        self.lookahead = self._lookahead(pairs, suffix)

    @staticmethod
    def _lookahead(pairs: list, suffix: str) -> int:
        """Most symbols from the end of what was read that symbols to come can still regroup.

        Merge a word with and without what follows, rule by rule. Left of a frontier both are grouped alike; at
        first it is the end of what was read. A rule (t, s) moves it, by the length of t, only if it joins the last
        group t of the equal part with a group s at the frontier. The next such rule is of a later rank, and its
        right part begins with t, as a group only grows: in both words t began where the frontier is now. So the
        longest chain of rules of rising rank, each right part beginning with the left part of the one before,
        bounds how far the frontier comes. Chains are followed from the last rule to the first.
        """
        symbols = lambda x: (x.removesuffix(suffix) if suffix else x, bool(suffix) and x.endswith(suffix))
        beyond: dict[str, int] = {}
        most = 1
        for a, b in reversed(pairs):
            (t, _), (s, ended) = symbols(a), symbols(b)
            reach = len(t) + beyond.get(t, 0)
            most = max(most, reach)
            for n in range(1, len(s) + (not ended)):  # a word's last symbol is another than the same byte within
                if beyond.get(s[:n], 0) < reach:
                    beyond[s[:n]] = reach
        return most

    def short(self, ids: list[int]) -> list[int]:
        """The tokens of a short symbol string: the lowest rank first, the leftmost of equals."""
        get, none = self.ranks.get, _NONE
        left = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while left:
            best = min(left)
            if best == none:
                break
            i, new = left.index(best), best & 0xFFFFFFFF
            ids[i : i + 2] = (new,)
            del left[i]
            if i:
                left[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(left):
                left[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def group(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """The tokens of a symbol string of any length, and their lengths, by a queue."""
        n, get = len(ids), self.ranks.get
        ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        while heap:
            best, i, right = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[j] != right or get(ids[i] << 32 | right) != best:
                continue
            new = best & 0xFFFFFFFF
            ids[i], alive[j] = new, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := get(new << 32 | ids[k]):
                    heappush(heap, (r, i, ids[k]))
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 32 | new)):
                heappush(heap, (r, h, new))
        starts = [i for i in range(n) if alive[i]]
        return [ids[i] for i in starts], [after[i] - i for i in starts]


class Transducer:
    """One word, fed in pieces: ``feed`` gives the tokens that are stable, ``close`` the rest."""

    def __init__(self, merges: Merges):
        self.merges, self.kept = merges, b""
        self.most = 4 * merges.lookahead + 64  # bytes that are ever held

    def feed(self, data: bytes) -> Iterator[int]:
        lookahead, symbols = self.merges.lookahead, self.merges.symbols
        at = 0
        while at < len(data):
            take = max(1, self.most - len(self.kept))
            self.kept += data[at : at + take]
            at += take
            if len(self.kept) < self.most:
                return
            ids, lengths = self.merges.group([symbols[b] for b in self.kept])
            end = 0
            for token, n in zip(ids, lengths, strict=True):
                if end + n > len(self.kept) - lookahead:
                    break
                yield token
                end += n
            # Tokens start afresh at a boundary that stays: no merge crosses it.
            self.kept = self.kept[end:]
            self.most = max(self.most, len(self.kept) + lookahead)  # tokens longer than the window

    def close(self, data: bytes = b"") -> list[int]:
        """The word's last bytes, if any are left, and its end."""
        data, self.kept = self.kept + data, b""
        if not data:
            return []
        ids = [*map(self.merges.symbols.__getitem__, data[:-1]), self.merges.lasts[data[-1]]]
        return self.merges.short(ids) if len(ids) <= SHORT else self.merges.group(ids)[0]


def byte_alphabet() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _may_begin(text: str, i: int) -> bool:
    """Whether a text may be cut before its i-th character: normalising never joins that with what is before, and no contraction spans it."""
    c = ord(text[i])
    joins = 0x1160 <= c <= 0x11FF or 0x16D63 <= c <= 0x16D6A  # vowels and finals of syllables
    return not joins and unicodedata.category(text[i])[0] != "M" and "'" not in text[max(0, i - 2) : i]


class Pieces(dict):
    """The ids of the parts of words, the strings that are merged on their own."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.held = merges, 0

    def __missing__(self, piece: str) -> bytes:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        out, data = Transducer(self.merges), piece.encode()
        ids = [*out.feed(data), *out.close()] if len(data) > SHORT else out.close(data)
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        self.held += 160 + len(data) + len(found)
        return found


class Encoder(dict):
    """Words (bytes) to their ids (little-endian, unsigned, four bytes each), computed once and remembered.

    For vocabularies that drop white space, so that words are independent of one another.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.merges = Merges(made["model"])
        self.pieces, self.held = Pieces(self.merges), 0
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.cut = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.plain = self._plain(made)
        self.bytes = {c: b for b, c in enumerate(byte_alphabet())}
        if self._words("a \n b") != [b"a", b"b"] or self._words("a b", False) != [b"a", b"b"]:
            raise ValueError("only vocabularies that drop white space can be encoded word by word")

    @staticmethod
    def _plain(made: dict):
        """What cuts a lower-case word of characters below U+0180, read off the vocabulary's own pattern; None where its steps are others."""
        steps = [s.get("type") for s in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
        pattern = cuts[0]["pattern"]["Regex"].replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")).replace(r"\s", r"\x09-\x0D\x20\x85\xA0")
        return None if r"\p" in pattern else re.compile(pattern).findall

    def _words(self, text: str, normal: bool = True) -> list[bytes]:
        if normal and self.normal is not None:
            text = self.normal.normalize_str(text)
        return [bytes(self.bytes[c] for c in piece) for piece, _ in self.cut.pre_tokenize_str(text)]

    def _sections(self, word: str) -> Iterator[tuple[str, int | None]]:
        for part in self.specials.split(word) if self.specials else [word]:
            if part:
                yield part, self.special.get(part)

    def __missing__(self, word: bytes) -> bytes:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        piece = self.pieces.__getitem__
        text = word.decode()
        if self.plain and _LATIN(text) and not self.marked(text):  # normal already
            found = b"".join(map(piece, self.plain(text.lower())))
        else:
            found = b"".join(struct.pack("<I", special) if special is not None else b"".join(piece(w.decode()) for w in self._words(part)) for part, special in self._sections(text))
        self.held += 160 + len(word) + len(found)
        self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()
        self.held = self.pieces.held = 0

    def stream(self, word: str) -> Iterator[int]:
        """The ids of one word of any length, read in pieces; what is open at a piece's end goes on in the next."""
        for part, special in self._sections(word):
            if special is not None:
                yield special
                continue
            out, run, at = Transducer(self.merges), "", 0
            while at < len(part):
                end = min(len(part), at + PIECE)
                while end < len(part) and end > at + PIECE // 2 and not _may_begin(part, end):
                    end -= 1
                while end < len(part) and not _may_begin(part, end):
                    end += 1
                text = self.normal.normalize_str(part[at:end]) if self.normal is not None else part[at:end]
                at = end
                pieces = self._words(run + text, False)  # an open run goes on as if it had begun with its stand-in
                for i, piece in enumerate(pieces):
                    if i == 0 and run:
                        piece = piece[1:]
                    elif i or not run:
                        yield from out.close()
                    yield from out.feed(piece)
                # A run of letters, or of other signs, may go on; a digit or a contraction is whole.
                last = pieces[-1].decode(errors="replace") if pieces else ""
                white = bool(text) and not self._words(text[-1], False)
                run = next((s for s in "a!" if last and not white and len(self._words(last + s, False)) == 1), "")
                if not run:
                    yield from out.close()
            yield from out.close()

    def encode(self, data: bytes) -> Iterator[bytes]:
        """The ids of a whole text, a slice of it at a time."""
        at = 0
        while at < len(data):
            end = len(data) if at + SLICE >= len(data) else self._gap(data, at + SLICE)
            words = data[at:end].split()  # at ASCII white space
            if max(map(len, words), default=0) <= LONG:
                yield b"".join(map(self.__getitem__, words))
            else:
                for word in words:
                    if len(word) <= LONG:
                        yield self[word]
                    else:
                        ids = self.stream(word.decode())
                        while len(part := np.fromiter(islice(ids, 65536), "<u4")):
                            yield part.tobytes()
            at = end

    @staticmethod
    def _gap(data: bytes, at: int) -> int:
        found = _WHITE.search(data, at)
        return found.start() if found else len(data)


class Decoder:
    """Ids to text, piece by piece. The state is an unfinished character, and whether a token went before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        strings = {i: t for t, i in made["model"]["vocab"].items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        kind = (made.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no state machine for a decoder of type {kind}")
        # Without a decoder the tokens' own strings are joined by blanks, as the library does.
        self.between = b"" if kind else b" "
        bytes_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        plain = lambda t: b"".join(bytes_of[c] for c in t) if kind and all(c in bytes_of for c in t) else t.encode()
        self.table = [plain(strings.get(i, "")) for i in range(max(strings, default=-1) + 1)]
        self.start()

    def start(self) -> None:
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if data and self.begun:
            data = self.between + data
        self.begun = self.begun or bool(data)
        return self.machine.decode(data)

    def close(self) -> str:
        """What is left: an unfinished character becomes a replacement character."""
        rest = self.machine.decode(b"", True)
        self.start()
        return rest


@lru_cache(maxsize=1)
def _machines(path: str) -> tuple[Encoder, Decoder]:
    """Once for a worker; what the encoder remembers goes with each task."""
    return Encoder(path), Decoder(path)


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded): every whole text as token ids (little-endian, unsigned, four bytes each) and those as text again.

    A map over texts without a shuffle. Texts are cut at ASCII white space; each distinct word runs through the
    transducer once in a task, words beyond ``LONG`` bytes every time, in pieces. A word of any length keeps
    ``4 * lookahead + 64`` bytes. Edge cases: a null or empty text, or one of blanks, has no ids and an empty
    decoded text; special tokens written in a text are those tokens; repeated rows and null doc_ids are rows of
    their own; other columns are ignored; an empty table gives no row.
    """

    @released
    def run(batches):
        encoder, decoder = _machines(tokenizer_path)
        ids_out, rows, held = [], [], 0
        try:
            for batch in batches:
                for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids, text = [], []
                    for part in encoder.encode(data or b""):
                        ids.append(part)
                        text.append(decoder.feed(np.frombuffer(part, "<u4").tolist()))
                    text.append(decoder.close())
                    ids_out.append(doc_id)
                    rows.append((b"".join(ids), "".join(text)))
                    held += len(rows[-1][0]) + len(rows[-1][1])
                    if held > OUT_BYTES:
                        yield _batch(ids_out, rows)
                        ids_out, rows, held = [], [], 0
            if rows:
                yield _batch(ids_out, rows)
        finally:
            encoder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(doc_ids: list, rows: list) -> pa.RecordBatch:
    ids, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])


def digest(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_and_decode`` returns."""
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
