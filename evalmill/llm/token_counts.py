"""Token counts by a compiled finite-state transducer and a scan over chunk maps.

A deterministic transducer reads a text character by character. Its state says how the split pattern stands (inside a run of
letters, digits or other characters, inside white space, after an apostrophe, between matches) and how the merges of the open
match stand: for every place where a token may have begun, the bytes since then, the last token before and the count up to
there, relative to the count of what was read; since tokens have bounded length there are finitely many such states. A
transition is annotated with the number of tokens by which the count changes, so the sum is right after every character; white
space whose last character may still go to the next match, and contractions, are corrected by the transition that decides
them. A whole match, read from between matches to between matches, is kept as one transition too, which is how the inside of a text
is run. All this rests on this property of ranked merges: a sequence of tokens is the encoding of its text if and only if each
neighbouring pair is the encoding of its own bytes. States and transitions are compiled when first reached, kept up to a fixed
number and compiled again after that.

A long text is cut into chunks, which Spark deals out as rows. A chunk's map takes each state to (state, count): it runs the
chunk's head, up to the first white space after an ASCII letter or digit or the end of a special string, where all states
meet in one, and adds the rest, which was run once from there. Maps compose associatively; a scan by halves gives the tokens before each
chunk and in all.

Special strings inside a text count as one token, as the library does by default. ``ODD`` characters may have other classes
in another Unicode version, so texts with them are split into matches by the library itself, each a run of the transducer.

Cases: a null text is empty: 0 bytes, 0 tokens; results don't depend on the chunk size.
"""

from __future__ import annotations

import json
import pickle
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import map_frames, table

#: Anything but code points whose class is the same in all Unicode versions in use: Latin to Cyrillic without the number
#: forms and the four separators that only some libraries call white space, punctuation, kana, Han.
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u0377\u0400-\u0527\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")

#: The split pattern for texts without ODD characters, in the standard library's terms.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")

NEVER = 1 << 60

#: Code points of a chunk; transitions of characters and of matches that a worker keeps.
CHUNK, KEPT = 32_768, 400_000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of a pretoken; ranks: token -> rank of its merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.grown: dict[bytes, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.size = 0
        self.start = self._state(((b"", None, 0),))

    def _state(self, live: tuple) -> int:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = len(self.live)
            self.live.append(live)
            self.next.append({})
        return found

    def edges(self, token: bytes) -> tuple[list, list]:
        """How the last and the first symbol of a token grow while it is merged: (symbol, rank of the merge that changes it)."""
        found = self.grown.get(token)
        if found is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            right, left = [], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                if i == 0:
                    left.append((parts[0], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            whole = len(parts) == 1
            found = self.grown[token] = (right + [(parts[-1], NEVER)], left + [(parts[0], NEVER)]) if whole else ([], [])
        return found

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether the two are the encoding of their bytes: no merge across the boundary comes before those inside."""
        left = self.edges(token)[1]
        if last is None or not left:
            return bool(left)
        right = self.edges(last)[0]
        i = j = 0
        while True:
            a, own = right[i]
            b, other = left[j]
            across = self.ranks.get(a + b, NEVER)
            if across < own and across <= other:
                return False
            if own <= other:
                if own == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        open_, new = [], None
        for since, last, count in self.live[state]:
            since += bytes((byte,))
            if since in self.ranks and new is None and self.follows(last, since):
                new = (since, count + 1)
            if since in self.prefixes:
                open_.append((since, last, count))
        token, count = new
        live = tuple((s, t, c - count) for s, t, c in open_) + ((b"", token, 0),)
        out = self.next[state][byte] = (self._state(live), count)
        self.size += 1
        return out

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """(state, tokens) after more bytes of a match."""
        found = 0
        for byte in data:
            step = self.next[state].get(byte)
            state, emitted = step if step is not None else self.compile(state, byte)
            found += emitted
        return state, found


#: What follows an apostrophe and a letter in the contractions of three characters.
LONGER = {"r": "e", "v": "e", "l": "l"}


class ChunkMap(NamedTuple):
    """state -> (state, count): run ``head``; without an ``exit`` that is all, else what follows it ends in ``exit`` with ``count`` more."""

    head: str
    exit: tuple | None
    count: int


class TextMachine:
    """The transducer over characters. A state is ("-",) between matches, (class, q) in a run, ("s", q, tokens that its last
    character added, that character) in white space, ("'", q) after an apostrophe that opens a match, ("c", letter, q) after one
    more letter that may make a contraction; q is the merges' state."""

    def __init__(self, bpe: Transducer, specials: list[str]):
        self.bpe = bpe
        names = "|".join(map(re.escape, sorted(specials, key=len, reverse=True)))
        self.specials = re.compile(names or r"(?!)")
        self.meets = re.compile("|".join(filter(None, [r"[A-Za-z0-9][ \t\n\r]", names])))
        self.reset()

    def reset(self) -> None:
        self.bpe.reset()
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.table: list[dict[str, tuple[int, int]]] = []
        self.matches: dict[str, int] = {}
        self.size = 0
        self.fresh = self.intern(("-",))

    def intern(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.table.append({})
        return found

    def exported(self, state: int) -> tuple:
        """The state in terms that another worker understands: (key, place of q in it, what q stands for)."""
        key = self.keys[state]
        at = {"-": 0, "s": 1, "'": 1, "c": 2}.get(key[0], 1)
        return key, at, self.bpe.live[key[at]] if at else None

    def imported(self, state: tuple) -> int:
        key, at, live = state
        return self.intern((*key[:at], self.bpe._state(live), *key[at + 1 :]) if at else tuple(key))

    def begin(self, char: str) -> tuple[tuple, int]:
        q, n = self.bpe.run(self.bpe.start, char.encode())
        if char.isspace():
            return ("s", q, n, char), n
        return ("'" if char == "'" else self.kind(char), q), n

    @staticmethod
    def kind(char: str) -> str:
        return "L" if LETTER.match(char) else "N" if DIGIT.match(char) else "O"

    def tokens(self, text: str) -> int:
        return self.bpe.run(self.bpe.start, text.encode())[1]

    def decide(self, key: tuple, char: str) -> tuple[tuple, int]:
        """(next state, change of the count)."""
        mode, space = key[0], char.isspace()
        kind = None if space else self.kind(char)
        if mode == "s" and space:
            q, n = self.bpe.run(key[1], char.encode())
            return ("s", q, n, char), n
        if mode == "s":
            _, _, given, last = key  # the last character of the white space is given back
            if last == " ":
                q, n = self.bpe.run(self.bpe.start, b" " + char.encode())
                return (kind, q), n - given
            new, n = self.begin(char)
            return new, n + self.tokens(last) - given
        if mode == kind:
            q, n = self.bpe.run(key[1], char.encode())
            return (kind, q), n
        if mode == "'" and char in "stmd":
            return ("-",), self.tokens("'" + char) - self.tokens("'")
        if mode == "'" and char in LONGER:
            q, n = self.bpe.run(self.bpe.start, char.encode())
            return ("c", char, q), n
        if mode == "'" and kind == "O":
            q, n = self.bpe.run(key[1], char.encode())
            return ("O", q), n
        if mode == "c" and char == LONGER[key[1]]:
            return ("-",), self.tokens("'" + key[1] + char) - self.tokens("'") - self.tokens(key[1])
        if mode == "c" and kind == "L":
            q, n = self.bpe.run(key[2], char.encode())
            return ("L", q), n
        return self.begin(char)

    def step(self, state: int, char: str) -> tuple[int, int]:
        key, n = self.decide(self.keys[state], char)
        self.size += 1
        found = self.table[state][char] = (self.intern(key), n)
        return found

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(state, count) after a text; a special string counts as one and leads to the state between matches."""
        total, table = 0, self.table
        parts = self.specials.split(text)
        for i, part in enumerate(parts):
            if i:
                state, total = self.fresh, total + 1
            for char in part:
                step = table[state].get(char)
                state, n = step if step is not None else self.step(state, char)
                total += n
        return state, total

    def between(self, text: str) -> int:
        """Tokens of a text that lies between matches at both ends: one transition for each match."""
        total, known, bpe = 0, self.matches, self.bpe
        parts = self.specials.split(text)
        for part in parts:
            for word in PLAIN.findall(part):
                found = known.get(word)
                if found is None:
                    found = known[word] = bpe.run(bpe.start, word.encode())[1]
                total += found
        return total + len(parts) - 1

    def tidy(self) -> None:
        """Forget all states once there are too many; none may be in use but exported ones."""
        if self.size + self.bpe.size > KEPT or len(self.matches) > KEPT:
            self.reset()

    def chunk_map(self, text: str) -> ChunkMap:
        self.tidy()
        first = self.meets.search(text)
        if not first:
            return ChunkMap(text, None, 0)
        # From the first meeting place to the last one the text lies between matches; what follows gives the exit.
        last = first
        for width in (256, len(text)):
            if later := list(self.meets.finditer(text, max(first.end(), len(text) - width))):
                last = later[-1]
                break
        special = lambda m: self.specials.fullmatch(m.group()) is not None
        start, end = (m.end() - (not special(m)) for m in (first, last))
        state, given = (self.fresh, 0) if special(last) else (lambda x: (self.intern(x[0]), x[1]))(self.begin(text[end]))
        after, more = self.run(state, text[last.end() :])
        before = 0 if special(first) else self.begin(text[start])[1]  # the head's last character is counted with the head
        count = self.between(text[start:end]) - before + given + more if last is not first else more
        return ChunkMap(text[: first.end()], self.exported(after), count)

    def compose(self, f: ChunkMap, g: ChunkMap) -> ChunkMap:
        if f.exit is None:
            return ChunkMap(f.head + g.head, g.exit, g.count)
        self.tidy()
        state, n = self.run(self.imported(f.exit), g.head)
        return ChunkMap(f.head, self.exported(state) if g.exit is None else g.exit, f.count + n + g.count)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive scan by halves: pairs are composed, their scan fills the odd places, one more composition the even ones."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]

    def count_from_start(self, f: ChunkMap) -> int:
        self.tidy()
        return self.run(self.fresh, f.head)[1] + f.count


class Counter:
    """Counts for whole texts with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as file:
            spec = json.load(file)
        self.letters = byte_letters()
        specials = [t["content"] for t in spec["added_tokens"]]
        bpe = Transducer({bytes(self.letters[c] for c in t): r for t, r in spec["model"]["vocab"].items() if t not in specials})
        self.machine = TextMachine(bpe, specials)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def odd_count(self, text: str) -> int:
        """Tokens of a text with characters of uncertain class: matches by the library, each a run of the merges' transducer."""
        parts, bpe, total = self.machine.specials.split(text), self.machine.bpe, 0
        for part in parts:
            for word, _ in self.split(part):
                total += bpe.run(bpe.start, bytes(map(self.letters.__getitem__, word)))[1]
        return total + len(parts) - 1

    def count(self, text: str) -> int:
        self.machine.tidy()
        return self.odd_count(text) if ODD.search(text) else self.machine.between(text)

    def chunked_count(self, text: str, chunk: int) -> int:
        """The count by chunk maps; ``text`` without ODD characters and no special string across a cut."""
        return self.machine.count_from_start(self.machine.scan([self.machine.chunk_map(text[i : i + chunk]) for i in range(0, max(1, len(text)), chunk)])[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def special_strings(path: str) -> list[str]:
    with open(path) as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def _moved(at: Column, specials: list[str]) -> Column:
    """The cut, or the end of the special string that it lies in."""
    for special in specials:
        n = len(special)
        begin = F.greatest(F.lit(0), at - (n - 1))
        place = F.call_function("locate", F.lit(special), F.substring(F.col("text"), begin + 1, F.lit(2 * n - 2)))
        at = F.when((at > 0) & (place > 0) & (begin + place - 1 < at), begin + place - 1 + n).otherwise(at)
    return at


def chunks_of(texts: DataFrame, specials: list[str], chunk: int) -> DataFrame:
    """Rows (doc_id, row, n_bytes, chunk_no, text) of the texts' chunks; a cut inside a special string moves behind it."""
    cuts = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)), lambda at: _moved(at, specials))
    placed = texts.withColumn("cuts", cuts)
    piece = lambda i: F.substring(F.col("text"), F.get("cuts", i) + 1, F.coalesce(F.get("cuts", i + 1), F.length("text")) - F.get("cuts", i))
    return placed.select("doc_id", "row", "n_bytes", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), piece)).alias("chunk_no", "text"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chunk_starts) of every whole text; chunk_starts: the tokens before each of its chunks.

    Texts of one chunk are counted where they lie. Chunks of longer ones are dealt out, and their maps, which are small, come
    together by text.
    """

    def short(batches):
        own = counter(path)
        for batch in batches:
            counts = [own.count(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts, "chunk_starts": [[0]] * len(counts)})

    def mapped(batches):
        machine = counter(path).machine
        for batch in batches:
            maps = [machine.chunk_map(t) for t in batch["text"]]
            yield batch.drop(columns="text").assign(head=[m.head for m in maps], exit=[pickle.dumps(m.exit) for m in maps], count=[m.count for m in maps])

    def scanned(batches):
        machine = counter(path).machine
        for batch in batches:
            rows = []
            for maps in batch["maps"]:
                found = machine.scan([ChunkMap(m["head"], pickle.loads(m["exit"]), m["count"]) for m in maps])
                counts = [machine.count_from_start(m) for m in found]
                rows.append((counts[-1], [0, *counts[:-1]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": [r[0] for r in rows], "chunk_starts": [r[1] for r in rows]})

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_ = (F.length("text") > chunk) & ~F.col("text").rlike(ODD.pattern)
    result = "doc_id long, n_bytes long, n_tokens long, chunk_starts array<long>"
    few = map_frames(texts.filter(~long_).select("doc_id", "n_bytes", "text"), short, result)
    dealt = chunks_of(texts.filter(long_), special_strings(path), chunk).repartition("row", "chunk_no")
    maps = map_frames(dealt, mapped, "doc_id long, row long, n_bytes long, chunk_no int, head string, exit binary, count long")
    whole = maps.groupBy("row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "head", "exit", "count"))).alias("maps"))
    return few.unionByName(map_frames(whole.select("doc_id", "n_bytes", "maps"), scanned, result)).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
