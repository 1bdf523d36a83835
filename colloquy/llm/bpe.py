"""BPE encoding and decoding, with long texts encoded as a tree of halves.

A long text is halved until its parts are short; the parts are encoded as rows of their own, on any executor. Two
neighbours are then joined: a window of text around the join is encoded again, and grows until, on either side of
the join, it shares a boundary with equal tokens before and after it. Two tokens that are neighbours in the
encoding of any text stay neighbours wherever they meet without other text between them, so what lies beyond the
agreed boundaries needs no second look and the result is exactly that of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm.common import column_udf, keep, store
from colloquy.llm.packing import byte_chars

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

LEAF = 16_384  # characters that are encoded in one go
WINDOW = 64  # characters on either side of a join, at first
CACHE = 150_000

_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0]+")


class WordBPE:
    """A tokenizer whose pre-tokenizer drops white space: words are encoded one by one, with a cache.

    normal() is the tokenizer's normalizer; encode() takes normalized text without special tokens.
    """

    def __init__(self, tokenizer_json: str):
        self.whole = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings")
        kinds = json.dumps(spec["pre_tokenizer"]), json.dumps(spec["normalizer"])
        if '"Removed"' not in kinds[0] or "\\\\s+" not in kinds[1]:
            raise ValueError("a tokenizer that keeps white space")
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}))
        self.plain = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.whole.no_truncation()
        self.whole.no_padding()
        vocab = spec["model"]["vocab"] | self.marks
        self.names = [""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            self.names[i] = w
        suffix = spec["model"]["end_of_word_suffix"] or ""
        # in such vocabularies one printable character stands for one byte
        self.size = [len(w.removesuffix(suffix)) if suffix else len(w) for w in self.names]
        self.cache: dict[str, bytes] = {}
        self.one = _single_words(spec, suffix)

    def normal(self, text: str) -> str:
        if self.plain:
            try:  # Latin-1 is composed already, and its lower case depends on nothing else
                text.encode("latin-1")
                return _SPACES.sub(" ", text.lower())
            except UnicodeEncodeError:
                pass
        return self.whole.normalizer.normalize_str(text)

    def _quick(self, word: str) -> bytes | None:
        """ids of a word of letters, with a comma or full stop perhaps; None if it needs the tokenizer."""
        if self.one is None or not word.isascii() and max(word) >= "Ԁ":
            return None
        if word.isalpha():
            parts = (word,)
        elif word[-1:] in (",", ".") and word[:-1].isalpha():
            parts = (word[:-1], word[-1])
        else:
            return None
        ids: list[int] = []
        for p in parts:
            ids += self.one(p.encode() + _END)
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """int32 ids. Words between spaces are independent: no pre-token holds white space."""
        words = text.split(" ")
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list({w for w in words if w not in cache})
        odd = []
        for w in new:
            ids = self._quick(w)
            if ids is None:
                odd.append(w)
            else:
                cache[w] = ids
        for w, e in zip(odd, self.bare.encode_batch_fast(odd, add_special_tokens=False) if odd else (), strict=True):
            cache[w] = array("i", e.ids).tobytes()
        return b"".join(map(cache.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def segments(self, text: str) -> list[str | int]:
        """text without special tokens, normalized, and the ids of those between."""
        if not self.at_marks or not any(m in text for m in self.marks):
            return [self.normal(text)]
        return [self.marks[p] if i % 2 else self.normal(p) for i, p in enumerate(self.at_marks.split(text))]

    def text_bytes(self, text: str, leaf: int = LEAF) -> bytes:
        """encode_text as int32 bytes."""
        parts = self.segments(text)
        if len(parts) == 1 and len(parts[0]) <= leaf:
            return self.encode_bytes(parts[0])
        return array("i", self.encode_text(text, leaf)).tobytes()

    def encode_text(self, text: str, leaf: int = LEAF) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            out += [part] if isinstance(part, int) else self.tree(part, leaf)
        return out

    def tree(self, text: str, leaf: int) -> list[int]:
        if len(text) <= leaf:
            return self.encode(text)
        parts = [(p, self.encode(p)) for p in halves(text, leaf)]
        return self.joined(parts)

    def joined(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """The encoding of all parts together from each part's own, pairwise in a tree."""
        while len(parts) > 1:
            parts = [(a[0] + b[0], self.join(*a, *b)) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) - len(parts) % 2 :]
        return parts[0][1] if parts else []

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        near = WINDOW
        while near < max(len(left), len(right)):
            l, r = left[-near:], right[:near]
            # characters can be cut from marks that combine with them, but normalized text is not normalized again
            w = self.encode(l + r)
            i = self._agree_left(a, w, l)
            j = self._agree_right(b, w, r)
            if i and j and i[1] <= len(w) - j[1]:
                return a[: i[0]] + w[i[1] : len(w) - j[1]] + b[j[0] :]
            near *= 2
        return self.encode(left + right)

    def _agree_left(self, a: list[int], w: list[int], text: str) -> tuple[int, int] | None:
        """(tokens of a kept, tokens of w dropped) at the first boundary in the window's left half where a and w
        have equal tokens on both sides."""
        span = _bytes(text)
        ends, at, k = {}, span, len(a)
        while k and at > 0:  # where a's tokens end, counted from the window's beginning
            ends[at] = k
            k -= 1
            at -= self.size[a[k]]
        at = 0
        limit = span - 16  # what stands at the very end of the left text may go on in the right one
        for n, t in enumerate(w[:-1]):
            at += self.size[t]
            if at > limit:
                return None
            k = ends.get(at)
            if k and k < len(a) and a[k - 1] == t and a[k] == w[n + 1]:
                return k, n + 1
        return None

    def _agree_right(self, b: list[int], w: list[int], text: str) -> tuple[int, int] | None:
        """(tokens of b dropped, tokens of w dropped at its end), from the window's right end."""
        span = _bytes(text)
        starts, at = {}, 0
        for k, t in enumerate(b):  # where b's tokens begin, counted from the join
            starts[at] = k
            at += self.size[t]
            if at >= span:
                break
        at = span
        for n in range(len(w) - 1, 0, -1):
            at -= self.size[w[n]]
            if at < 16:
                return None
            k = starts.get(at)
            if k and at <= span - 16 and b[k] == w[n] and b[k - 1] == w[n - 1]:
                return k, len(w) - n
        return None

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_END = b"\xff"  # no UTF-8 text holds this byte; it stands for the end of a word


def _single_words(spec: dict, suffix: str):
    """A faster encoder of single pre-tokens with the same merges, or None if the vocabulary's order forbids it.

    With ids in merge order, "x</w>" can be spelt as the bytes of x and an end byte: these 256 merges come first.
    """
    vocab = spec["model"]["vocab"]
    order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if suffix != "</w>" or order != sorted(order) or order[0] < 512:
        return None
    chars = byte_chars()
    added = {t["id"] for t in spec["added_tokens"]}
    ranks = {}
    for w, i in vocab.items():
        if i not in added:
            ranks[bytes(chars[c] for c in w.removesuffix(suffix)) + (_END if w.endswith(suffix) else b"")] = i
    if len(ranks) != len(vocab.keys() - {t["content"] for t in spec["added_tokens"]}):
        return None
    return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _bytes(text: str) -> int:
    """UTF-8 bytes without spaces, the only white space of normalized text: what tokens cover."""
    return len(text.replace(" ", "").encode("utf-8", "surrogatepass"))


def halves(text: str, leaf: int) -> list[str]:
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def loaded(tokenizer_json: str) -> WordBPE:
    return keep("bpe", hash(tokenizer_json), lambda: WordBPE(tokenizer_json))


def _lists(rows: list[bytes]) -> pa.Array:
    """A list array of int32 from rows of int32 bytes."""
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]))


def _spec(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id and ids, one row for each row of docs; null and empty texts have no ids, repeated rows are encoded
    each. Texts of up to leaf characters are encoded where they lie. Longer ones are halved; their parts go out as
    rows, hash-dealt so that one very long text occupies many tasks, and are joined per text again."""
    spec = _spec(docs, tokenizer)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    whole = column_udf(lambda t: _lists([loaded(spec.value).text_bytes(x or "", leaf) for x in t]), "array<int>")
    short = own.where(~long).select("doc_id", whole(F.col("text")).alias("ids"))

    def split(texts):
        bpe, out = loaded(spec.value), []
        for t in texts:
            rows = []
            for s, part in enumerate(bpe.segments(t)):
                pieces = [str(part)] if isinstance(part, int) else halves(part, leaf)
                rows += [{"segment": s, "leaf": i, "mark": isinstance(part, int), "part": p} for i, p in enumerate(pieces)]
            out.append(rows)
        return out

    def encode(parts, marks):
        bpe = loaded(spec.value)
        return [[int(p)] if m else bpe.encode(p) for p, m in zip(parts, marks, strict=True)]

    def join(rows):
        bpe, out = loaded(spec.value), []
        for row in rows:
            ids: list[int] = []
            held: list[tuple[str, list[int]]] = []
            last = None
            for r in sorted(row, key=lambda r: (r["segment"], r["leaf"])):
                if r["segment"] != last and held:
                    ids += bpe.joined(held)
                    held = []
                last = r["segment"]
                held.append((r["part"], r["ids"]))
            out.append(ids + bpe.joined(held))
        return out

    # a row's own number tells repeated rows apart; it is written down before anything depends on it
    cut = own.where(long).select("doc_id", F.expr("uuid()").alias("row"), column_udf(split, "array<struct<segment:int,leaf:int,mark:boolean,part:string>>")(F.col("text")).alias("l"))
    leaves = store(cut.select("doc_id", "row", F.explode("l").alias("l")).select("doc_id", "row", "l.*"), "leaves")
    encoded = leaves.repartition("row", "segment", "leaf").select("doc_id", "row", F.struct("segment", "leaf", "part", column_udf(encode, "array<int>")(F.col("part"), F.col("mark")).alias("ids")).alias("l"))
    trees = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("l").alias("l"))
    return short.unionByName(trees.select("doc_id", column_udf(join, "array<int>")(F.col("l")).alias("ids")))


def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """encoded with column decoded: the text of ids, special tokens included; null ids decode as none."""
    spec = _spec(encoded, tokenizer)

    def texts(lists):
        names = pa.array(loaded(spec.value).names, pa.string())
        words = names.take(lists.flatten())
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes), words), " ")

    decode = column_udf(texts, "string", raw=True)
    return encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"], decode(F.col(ids)).alias("decoded"))
