"""Operator 8: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is encoded as the library does it: space becomes U+2581, one such mark is put before a text that
isn't empty, and adjacent symbols are merged in the order of the merged piece's score, the leftmost
first among equals. The candidates wait in an agenda (a heap); one that an earlier merge made stale is
skipped. What no piece covers falls back to byte pieces.

Merges never cross a place where no piece holds both neighbours: before a mark after another character,
beside a line feed, between punctuation and letters (found from the pieces when the model is loaded; else
texts are encoded whole). A text is cut there, and each
distinct segment is encoded once for a worker, within a bounded memo. Each Arrow batch checks the
segments that it encodes anew against the sentencepiece library, ids and decoded text.

Decoding takes a document's ids alone: their pieces are joined, runs of byte pieces become UTF-8, the mark
becomes a space, and the prefix mark and the end id go, as the library's decode(ids) does it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, map_columns

MARK, NEVER = "▁", float("inf")


class Vocabulary:
    """The pieces of a merge-type model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = {i: b for b, i in enumerate(self.byte)}
        self.id = {
            p: i
            for i, p in enumerate(self.names)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        self.rank = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.eos = sp.eos_id()
        if sp.encode("a  b") != [*sp.encode("a"), *self.merge(f"{MARK}{MARK}b")]:
            raise ValueError("only models that keep white space and add a prefix mark are supported")
        self.segment = re.compile(self.cuts()).findall
        self.plain = [p.replace(MARK, " ") for p in self.names]
        self.plain[self.eos] = ""
        # The bytes of all pieces one after another, and where each begins and how many it has.
        pieces = [bytes((self.is_byte[i],)) if i in self.is_byte else x.encode() for i, x in enumerate(self.plain)]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(x) for x in pieces])
        self.begin = np.cumsum(self.size) - self.size

    def cuts(self) -> str:
        """Pattern of the segments that no merge leaves: see the module's text."""
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.id):
            return r"(?s:.+)"
        beside: dict[str, set[str]] = {}
        for p in self.id:
            for x, y in zip(p, p[1:], strict=False):
                if x != MARK:
                    beside.setdefault(x, set()).add(y)
                    beside.setdefault(y, set()).add(x)
        signs = [x for x in string.punctuation if not any(y.isalnum() for y in beside.get(x, ()))]
        if not signs:
            return f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
        own, letter, end = re.escape("".join(signs)), r"[^\W_]", rf"{MARK}\n]|\Z)"
        return (
            f"\n|{MARK}*{letter}+(?=[{own}{end}|{MARK}*[{own}]+(?:(?={letter})|(?=[{end})"
            f"|{MARK}*[^{MARK}\n]+|{MARK}+"
        )

    def merge(self, text: str) -> list[int]:
        """Ids of a marked text, by the agenda."""
        ids: list[int] = []
        for x in self._short(text) if len(text) <= 40 else self._long(text):
            found = self.id.get(x)
            if found is None:
                ids += [self.byte[b] for b in x.encode()]
            else:
                ids.append(found)
        return ids

    def _short(self, text: str) -> list[str]:
        """The agenda as a list in text order: its first minimum is the next merge."""
        part, rank = list(text), self.rank.get
        agenda = [rank(x, NEVER) for x in map(add, text, text[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            del agenda[i]
            part[i] = joined = part[i] + part.pop(i + 1)
            if i < len(agenda):
                agenda[i] = rank(joined + part[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(part[i - 1] + joined, NEVER)
        return part

    def _long(self, text: str) -> list[str]:
        """The agenda as a heap over linked symbols; what a merge made stale is skipped."""
        n, find = len(text), self.rank.get
        part: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [
            (rank, i, i + 1, x) for i, x in enumerate(map(add, text, text[1:])) if (rank := find(x)) is not None
        ]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, j, joined = pop(agenda)
            if after[i] != j or len(part[i]) + len(part[j]) != len(joined) or not part[i]:
                continue
            part[i], part[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := find(x := joined + part[k])) is not None:
                    push(agenda, (rank, i, k, x))
            if (h := before[i]) >= 0 and (rank := find(x := part[h] + joined)) is not None:
                push(agenda, (rank, h, i, x))
        return [x for x in part if x]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without dropping the prefix mark."""
        if self.is_byte.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out = bytearray()
        for i in ids:
            b = self.is_byte.get(i)
            out += self.plain[i].encode() if b is None else bytes((b,))
        return out.decode("utf-8", "replace")

    def decode_document(self, ids: np.ndarray) -> bytes:
        """Text of a document's ids as UTF-8: the prefix mark and the end id have no text."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        at = np.repeat(self.begin[ids] - before, size) + np.arange(int(size.sum()))
        return self.flat[at].tobytes()[1:]  # of the end id alone, nothing

    def check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compare with the library: a segment without a mark, or of the mark alone, is put behind a line feed."""
        alone = [s[0] == MARK and len(s) > 1 for s in segments]
        given = [s[1:] if x else "\n" + s.replace(MARK, " ") for s, x in zip(segments, alone, strict=True)]
        theirs = self.sp.encode(given)
        for s, x, own, ids_, back in zip(segments, alone, ids, theirs, self.sp.decode(theirs), strict=True):
            text = s.replace(MARK, " ")
            if ids_[0 if x else 2 :] != own or self.decode(own) != text or back[0 if x else 1 :] != text[1 if x else 0 :]:
                raise ValueError(f"the agenda and the library differ on {s[:80]!r}")


class Memo(dict):
    """word -> the ids of the mark and the word, joined by a space; bounded, so a worker's memory is too.

    A word that begins with a line feed has no mark. Two generations: when the younger is full it becomes
    the older one, and what is used of that moves on.
    """

    LIMIT, LONGEST, UNCHECKED = 200_000, 200, 20_000

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.older, self.signs = vocabulary, {}, {}
        self.new: list[str] = []
        self.new_ids: list[str] = []

    def __missing__(self, word: str) -> str:
        made = self.older.get(word)
        if made is None:
            made = self.marked(word if word[:1] == "\n" else MARK + word)
        if len(word) <= self.LONGEST:
            self[word] = made
        return made

    def marked(self, text: str) -> str:
        """The ids of a marked text, from its segments."""
        segments = self.v.segment(text)
        return " ".join([self.segment(x, len(segments) > 1) for x in segments])

    def segment(self, text: str, part: bool) -> str:
        known = self if text[0] == MARK and text[1:2] not in ("\n", MARK) else self.signs
        key = text[1:] if known is self else text
        if part and (made := known.get(key)) is not None:
            return made
        ids = " ".join(map(str, self.v.merge(text)))
        self.new.append(text)
        self.new_ids.append(ids)
        if part and len(key) <= self.LONGEST:
            known[key] = ids
        return ids

    def settle(self, least: int = 0) -> None:
        """Check what is new, from `least` segments on."""
        if len(self.new) < least:
            return
        self.v.check(self.new, [list(map(int, x.split(" "))) for x in self.new_ids])
        self.new, self.new_ids = [], []
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        if len(self.signs) > self.LIMIT // 4:
            self.signs.clear()


def encode_text(memo: Memo, text: str) -> str:
    """The ids with the end id, joined by a space."""
    if not text:
        return str(memo.v.eos)
    if "  " in text or text[0] == " " or MARK in text:
        ids = memo.marked(MARK + text.replace(" ", MARK))
    else:
        ids = " ".join(map(memo.__getitem__, text.replace("\n", " \n").split(" ")))
    return f"{ids} {memo.v.eos}"


def encode(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of (doc_id, text); keep_ids adds the
    ids (array of int) and the decoded text.

    model: path of the model file, the same on every executor. A null text counts as empty: its only id
    is the end id. Rows are independent of each other: repeated rows and ids repeat, an empty table
    gives an empty one, and further columns are ignored.
    """

    def run(doc_ids: list, texts: list) -> list:
        memo = held(("pieces", model), lambda: Memo(Vocabulary(model)))
        n, ids_sha, text_sha, ids, back = [], [], [], [], []
        for t in texts:
            coded = encode_text(memo, (t or b"").decode("utf-8", "replace"))
            own = np.fromstring(coded, np.int32, sep=" ")
            decoded = memo.v.decode_document(own)
            n.append(len(own))
            ids_sha.append(hashlib.sha256(coded.encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded).hexdigest())
            memo.settle(memo.UNCHECKED)
            if keep_ids:
                ids.append(own)
                back.append(decoded.decode("utf-8", "replace"))
        memo.settle()
        return [doc_ids, n, ids_sha, text_sha, *([ids, back] if keep_ids else [])]

    schema, out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ]
    if keep_ids:
        schema += ", ids array<int>, decoded string"
        out += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return map_columns(docs, ["doc_id", "text"], run, schema, pa.schema(out))
