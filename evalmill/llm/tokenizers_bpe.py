"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's element is the list of its split-pattern matches, each with its ids, as found in that text alone. Halves are encoded
recursively; two neighbours are joined by splitting a window of matches around their boundary again. The window doubles until
the matches outside provably don't change:

* Left of it, a match is final once two characters and one that isn't white space follow it: the pattern looks no further
  (contractions need two characters, white-space runs the first character after them).
* Right of it, what is matched from a place on depends only on the text from there on (the pattern looks at nothing before a
  match). So once a match of the window ends where one of the right half begins, the rest stays as it was.

A long match is encoded the same way over its bytes: halves recursively, then the tokens of a window around the boundary are
merged again; it doubles until the pairs (token before it, its first) and (its last, token after it) are the encodings of
their own bytes. Ranked merges have the property that a token sequence is the encoding of its bytes if every neighbouring
pair is, so the result doesn't depend on how a text was cut. Decoding joins the bytes of halves up the same kind of tree.

Characters whose class isn't the same in all Unicode versions in use (``unstable_characters``) may be split otherwise by another
library; texts that hold one are encoded whole by the tiktoken library.

Cases: a null text is empty and has no ids; very long texts, words and white-space runs need memory in proportion to one
text; rows stay rows: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

#: White space as the split pattern has it, in runs that aren't left to a library's pattern.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]{65536,}")

#: Code points of a leaf; bytes of a match that the library merges in one go; matches and pairs kept by a worker.
LEAF, PIECE, KEPT = 1024, 64, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def unstable_characters() -> set[int]:
    """Code points that may be letters, digits or white space in one Unicode version and not in another.

    Stable ones were the same kind in version 3.2 as now, or were given since then and are no letters and digits.
    """
    kind = lambda category: category[0] if category[0] in "LNZ" else "-"
    old, odd = unicodedata.ucd_3_2_0, {0x1C, 0x1D, 0x1E, 0x1F, 0x85}
    for code in range(0x110000):
        now = unicodedata.category(char := chr(code))
        if now != "Co" and now != "Cs" and (now == "Cn" or kind(now) != kind(old.category(char))):
            odd.add(code)
    return odd


def character_class(codes) -> str:
    parts = []
    for code in sorted(codes):
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]"


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def whole_encoder(encode, encode_match):
    """``encode`` for any text: long runs of white space are cut out and go to ``encode_match`` as the matches that they are."""

    def ids_of(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_BLANKS.finditer(text) if len(text) >= 65536 else ():
            end = run.end() - (run.end() < len(text))
            ids += encode(text[at : run.start()])
            ids += encode_match(text[run.start() : end].encode())
            at = end
        return ids + encode(text[at:]) if at else encode(text)

    return ids_of


class TreeCodec:
    """Encodes by joining halves. ``merge`` gives the ids of a match's bytes; ``whole`` those of a text with unstable characters."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merge, whole, leaf: int = LEAF, piece: int = PIECE):
        import regex

        self.split, self.merge, self.leaf, self.piece = regex.compile(pattern).findall, merge, leaf, piece
        self.whole = whole_encoder(whole, self.match_ids)
        odd = unstable_characters()
        self.unstable, self.odd = re.compile(character_class(c for c in odd if c < 0x10000)).search, odd
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.words: dict[str, tuple] = {}
        self.pairs: dict[tuple, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def match_ids(self, data: bytes) -> list[int]:
        """Ids of one match's bytes, by halves."""
        if len(data) <= self.piece:
            return self.merge(data)
        half = len(data) // 2
        left, right, k = self.match_ids(data[:half]), self.match_ids(data[half:]), 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(map(self.pieces.__getitem__, left[a:] + right[:b])))
            if (not a or self.fits(left[a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def word_ids(self, word: str) -> tuple:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > KEPT:
                self.words.clear()
            data = word.encode()
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else tuple(self.match_ids(data))
            if len(word) <= self.piece:
                self.words[word] = found
        return found

    def element(self, text: str) -> tuple[list[str], list[tuple]]:
        """(matches, their ids) of a text on its own."""
        if len(text) <= self.leaf:
            words = self.split(text)
            return words, [self.word_ids(w) for w in words]
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    def join(self, left, right):
        if not left[0] or not right[0]:
            return left if left[0] else right
        k = 2
        while True:
            a, b = max(0, len(left[0]) - k), min(len(right[0]), k)
            before = "".join(left[0][a:])
            if not a or (len(before) > 1 and not before.isspace()):
                words = self.split(before + "".join(right[0][:b]))
                if b == len(right[0]):
                    last, rest = len(words), b
                else:
                    starts = dict(zip(accumulate(map(len, right[0][:b]), initial=len(before)), range(b + 1)))
                    ends = list(accumulate(map(len, words)))
                    # A common place inside the window, after which enough of it was seen for the match that ends there.
                    last, rest = next(((i + 1, starts[e]) for i, e in enumerate(ends) if e in starts and starts[e] < b and self.final(words, i)), (0, 0))
                if last:
                    middle = words[:last]
                    return left[0][:a] + middle + right[0][rest:], left[1][:a] + [self.word_ids(w) for w in middle] + right[1][rest:]
            k *= 2

    @staticmethod
    def final(words: list[str], i: int) -> bool:
        after = "".join(words[i + 1 : i + 4])
        return len(after) > 1 and not after.isspace()

    def encode(self, text: str) -> np.ndarray:
        if self.unstable(text) or any(ord(c) in self.odd for c in ASTRAL.findall(text)):
            return np.asarray(self.whole(text), dtype="<u4")
        return np.fromiter(chain.from_iterable(self.element(text)[1]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.pieces.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, leaf: int = LEAF, piece: int = PIECE) -> TreeCodec:
    """One for each Python worker."""
    import tiktoken

    ranks = read_ranks(path)
    library = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return TreeCodec(ranks, pattern, library._encode_single_piece, library.encode_ordinary, leaf, piece)


def encode_decode(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""

    def run(batches):
        own = codec(path, pattern, leaf)
        for batch in batches:
            ids = [own.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [own.decode(x) for x in ids]})

    return map_frames(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids array<long>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """The digests of ``encode_decode`` made where the ids are, so that they aren't sent back to the JVM."""

    def run(batches):
        own = codec(path, pattern, leaf)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = own.encode(text)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(doc_id=batch["doc_id"])

    return map_frames(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
