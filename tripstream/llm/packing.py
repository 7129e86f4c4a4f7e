"""Packing tokenized documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, give_back, pick

CAPACITY = 4096
END_ID = 1
#: Rows of one length are numbered in slices of about so many.
SLICE_ROWS = 256
#: So many slices at most, besides one for each length.
SLICES = 200_000
#: Runs of characters whose ids a worker remembers.
MEMO = 800_000

#: Letters beyond ASCII that have no other form and one lower case; texts of these and ASCII take the short way.
_LATIN = "\u00df-\u00f6\u00f8-\u00ff"
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: How this vocabulary cuts lower-case text of that kind into words.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^ \\t-\\ra-z0-9{_LATIN}]+")
#: A run of one word, cut and in lower case already.
_WORD = re.compile(f"[a-z{_LATIN}]+")
#: A stop or comma at the end of a run, after another sign; it begins with the stop, so that few places are tried.
_SIGNS = re.compile(f"[.,](?<=[^ \\t-\\ra-z0-9{_LATIN}][.,])(?:[ \\t-\\r]|\\Z)")
#: White space of the tokenizer's own pattern; str.split() also splits at 0x1C to 0x1F.
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def _plain(text: str) -> bool:
    """Whether text has nothing but ASCII and such letters, and no special token."""
    return not _OTHER.search(text) and "<|" not in text


class Encoder:
    """The ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no word crosses it, so that each run of other characters has ids of its
    own; runs met before are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # words that are cut and in lower case already need the merges only
        own = json.loads(self.tokenizer.to_str())
        own["normalizer"], own["added_tokens"] = None, []
        own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *own["pre_tokenizer"]["pretokenizers"][1:]]}
        self.merges = Tokenizer.from_str(json.dumps(own))
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        """Runs without white space; of plain texts in lower case, and without the stop or comma behind them."""
        if not _plain(text):
            return [r for r in _SPACES.split(text) if r]
        text = text.lower()
        if not _SIGNS.search(text):
            for sign in ".,":
                text = text.replace(f"{sign} ", f" {sign} ").replace(f"{sign}\n", f" {sign}\n")
        return text.split()

    def _any(self, strings: list[str]) -> list[bytes]:
        """Ids of strings without white space, encoded as parts of a few long texts."""
        out = []
        for lo in range(0, len(strings), 512):
            some = strings[lo : lo + 512]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, starts = np.array(done.ids, "<u4"), np.array([a for a, _ in done.offsets], np.int64)
            cuts = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in some]))))
            out += [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: each ends with the first id that ends a word."""
        out = []
        for lo in range(0, len(words), 2048):
            some = words[lo : lo + 2048]
            (done,) = self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(done.ids, "<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) != len(some):
                out += self._any(some)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, missing: list[str]) -> None:
        words, several, rest = set(), {}, []
        for r in missing:
            if _WORD.fullmatch(r):
                words.add(r)
            elif not _plain(r) or r.lower() != r:
                rest.append(r)
            else:
                several[r] = _WORDS.findall(r)
        words.update(w for ws in several.values() for w in ws if w not in self.runs)
        new = list(words)
        self.runs.update(zip(new, self._words(new), strict=True))
        for r, ws in several.items():
            self.runs[r] = b"".join([self.runs[w] for w in ws])
        self.runs.update(zip(rest, self._any(rest), strict=True))

    def __call__(self, texts: list[str], chunk: int = 2_000_000) -> Iterator[bytes]:
        """In order, for each text; about `chunk` characters are looked up together."""
        some, size = [], 0
        for t in texts:
            some.append(self._cut(t))
            size += len(t)
            if size >= chunk:
                yield from self._chunk(some)
                some, size = [], 0
        yield from self._chunk(some)

    def _chunk(self, some: list[list[str]]) -> Iterator[bytes]:
        missing = [r for r in set().union(*some) if r not in self.runs]
        full = len(self.runs) >= MEMO
        if missing:
            self._learn(missing)
        for own in some:
            yield b"".join(map(self.runs.__getitem__, own))
        if full:  # the frequent runs came early and stay
            for r in missing:
                del self.runs[r]
            if len(self.runs) > 2 * MEMO:
                self.runs.clear()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process: tasks that run in one worker share what it remembers."""
    return Encoder(path)


def _pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out = []
            for doc_id, ids in zip(b["doc_id"], encode([t or "" for t in b["text"]]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at : at + 4 * CAPACITY]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})
        give_back()

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to room without exceeding it.

    Bit s of an integer says that the sum s can be made of the lengths so far; longer ones come first.
    """
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            stages.append((length, reach))
            reach = more
        if reach >> room:
            break
    left, use = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        if not before >> left & 1:
            use[length] = use.get(length, 0) + 1
            left -= length
    return use


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first sequence, how many sequences, [(length, how many in each)]): every piece in a sequence.

    Each sequence takes the longest piece left and the fullest combination beside it; a combination is repeated
    as often as the pieces last, so that the work follows the number of lengths, not of pieces.
    """
    left = {x: n for x, n in counts.items() if n}
    out, at = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        use = fullest(left, capacity - longest)
        left[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(left[x] // n for x, n in use.items())
        out.append((at, times, sorted(use.items(), reverse=True)))
        at += times
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def _places(runs: list) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, pieces in each sequence, offset of the first), by rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    for first, times, items in runs:
        offset = 0
        for length, n in items:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, first, n, offset))
            used[length] = rank + times * n
            offset += length * n
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0 without gaps within each length.

    Rows of a length are dealt over slices by a hash, slices are counted before anything is sorted, and no task
    holds more than a slice of a length.
    """
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    width = F.lit(max(SLICE_ROWS, pieces.count() // SLICES))
    lengths = F.broadcast(lengths.select("length", F.ceil(F.col("n") / width).cast("long").alias("slices")))  # CAPACITY rows at most
    dealt = pieces.join(lengths, "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "slices")).drop("slices")
    sizes = dealt.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    dealt = dealt.withColumn("row", F.row_number().over(inside) - 1)
    return dealt.join(sizes, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("row"))


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path: a tokenizer file, at the same place on every machine. A document's ids are its text's, then END_ID; a
    null or empty text has END_ID alone. Only documents longer than CAPACITY are cut. A sequence holds CAPACITY
    ids at most and has no gaps. Rows that repeat a doc_id are packed each for itself. No rows give no rows.
    Ids are computed once and their lengths written to the shared folder; the driver sees counts by length only.
    """
    src = pick(docs, doc_id="long", text="string")
    pieces = cut(src.mapInPandas(_pieces(path), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            got = np.zeros((len(b), 2), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = places[int(x)]
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - r[:, 0]
                got[at, 0] = r[:, 1] + k // r[:, 2]
                got[at, 1] = r[:, 3] + k % r[:, 2] * x
            yield b.drop(columns="rank").assign(sequence_id=got[:, 0], offset=got[:, 1])

    ranked = numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
