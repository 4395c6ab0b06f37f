"""Suffix-array dedup: bytes of passages that an earlier document has are removed.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document
with a smaller id. Equal strings are found with suffix arrays (``suffix_array``),
whose sorted order puts them side by side. One array over the corpus is out of
reach, so the work is cut such that equal strings always meet:

1. Every ``SPAN`` bytes have an anchor, the run of ``GRAM`` bytes in them with the least
   hash. Neighbouring strings with the same anchor are a block. Equal strings
   have equal anchors, so they are found among the blocks of one anchor.
2. Blocks are dealt by anchor, as hashes; equal blocks are combined before, so a
   passage that is in a third of all documents is one row per chunk. A block
   that a smaller id has is covered whole. If an anchor has a single block,
   it is done; otherwise each of its blocks goes on, as often as the least id has it.
3. The bytes of those blocks are dealt by anchor again, the anchor itself written as
   one symbol, and a suffix array orders them. Strings that are equal to
   their neighbours form runs; those not of the run's least id are covered.
   Of equal blocks one is in the array, and what is found in it goes from every copy.
   Which strings start in the same document only is found by hashes before, and
   blocks without any other are left out of the array: no other block can hold an equal string.

Hot anchors. A passage that is in very many documents leaves a different block at
its edges in each, all of one anchor. Anchors with more than ``SPLIT_BLOCKS`` different
blocks are split: each of their strings is dealt by itself, by a hash of its bytes,
one copy per chunk, and compared byte by byte. Anchors that a sample of
documents tells to have more blocks than a part should hold (``SAMPLE``, ``SAMPLE_HOT``) are
dealt by block in step 2 and split as well. The sample decides where work is done, never what is found.

Blocks are compared by 96 bits of two hashes and more, the part's: at 100 TB, some 8e12 blocks, a
single pair is expected to be taken for equal with a probability of 1e-3 or less. Strings in arrays are
compared symbol by symbol, an anchor's 24 bytes by 64 bits. Copies of whole passages are thus settled by
hashes of blocks (nine tenths of the removed bytes of the test tables), their edges by suffix arrays.

Defined cases: a null text is empty; rows without an id are left whole and
remove nothing; ids of any type that has an order are compared in that order; repeated rows of an id do not remove each other; texts shorter
than ``SPAN`` bytes are left whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from collatrix.llm.store import documents, materialize, release_memory, released, released_each, small_batches
from collatrix.llm.suffix_array import suffix_array
from collatrix.operators.ranking import in_order

SPAN = 50
GRAM = 24
#: Strings per anchor's reach, and symbols of a string when its anchor is one.
REACH = SPAN - GRAM + 1
#: Bytes of text that a task cuts into blocks at a time, and least bytes per part that blocks are dealt to.
CHUNK = 6 << 20
PART = 4 << 20
#: Symbols that one suffix array holds, unless one anchor has more.
ARRAY = 10_000
#: Different blocks of an anchor that go to one array; anchors with more are split.
SPLIT_BLOCKS = 4096
#: One of how many documents is looked at for hot anchors, and in how many of these an anchor is hot.
SAMPLE, SAMPLE_HOT = 1 << 14, 32
#: Longer texts are cut in pieces that overlap; the strings stay the same.
PIECE = 1 << 22

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
COVERED, WANTED, SPLIT = 1, 2, 3


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTERS = tuple(scramble(np.arange(256, dtype=_U) + _U(seed)) | _U(1) for seed in (1 << 20, 1 << 30))
_POWERS = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2 ** 64."""
    for i, base in enumerate((_BASE, _INVERSE)):
        while len(_POWERS[i]) <= n:
            own = _POWERS[i]
            _POWERS[i] = np.concatenate([own, own * _U(pow(base, len(own), 1 << 64))])
    return _POWERS


def blocks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, block hash, first string, last string + 1, anchor's place) of a text, in order."""
    if len(text) > PIECE:
        found = []
        for at in range(0, len(text) - SPAN + 1, PIECE - SPAN + 1):
            a, h, s, e, p = blocks(text[at : at + PIECE])
            found.append((a, h, s + at, e + at, p + at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    x = np.frombuffer(text, dtype=np.uint8)
    n = len(x)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(_U), none.astype(_U), none, none, none
    up, down = _powers(n)
    sums = []
    for letters in _LETTERS:
        c = np.zeros(n + 1, dtype=_U)
        np.cumsum(letters[x] * up[:n], out=c[1:])
        sums.append(c)
    grams = scramble((sums[0][GRAM:] - sums[0][: n - GRAM + 1]) * down[: n - GRAM + 1])
    least = (grams & _U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=_U)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: width - REACH], least[REACH - width :])
    place = (least & _U(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(place)]
    hashed = scramble((sums[1][last + SPAN - 1] - sums[1][first]) * down[first])
    return grams[place[first]], hashed, first, last, place[first]


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether values are among those of a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def part_of(anchor: np.ndarray, hashed: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Where blocks are dealt to: by anchor, those of a hot anchor by block."""
    own = np.where(is_in(anchor, hot), anchor ^ scramble(hashed), anchor)
    return ((own >> _U(32)) % _U(parts)).astype(np.int64)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _packed(**columns) -> dict:
    return {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in columns.items()}


def hot_anchors(texts: DataFrame, sample: int = SAMPLE, least: int = SAMPLE_HOT) -> np.ndarray:
    """Anchors that are in ``least`` or more of a sample of documents, sorted: few, however large the corpus, as each stands for ``sample`` * ``least`` documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"anchor": np.unique(blocks(_encoded(text))[0]).view(np.int64)})

    some = texts.where(F.pmod(F.xxhash64("id", "text_hash"), F.lit(sample)) == 0).select("text")
    often = some.mapInPandas(released_each(run), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["anchor"] for r in often.collect()], dtype=np.int64).view(_U))


DEALT = "part int, chunk string, ids binary, texts binary, docs binary, counts binary, low binary, high binary"
DEALT_COLUMNS = [x.split()[0] for x in DEALT.split(", ")]


def cut_chunks(parts: int, hot: np.ndarray):
    """Chunks of documents as rows for each part, and one row with what is needed later.

    A row for a part has runs: the documents that have blocks for it, and how many each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen, size, made = [], set(), 0, 0
        for batch in batches:
            for i, t, text in zip(batch["id"], batch["text_hash"], batch["text"], strict=True):
                if (i, t) in seen:  # a row that repeats
                    continue
                seen.add((i, t))
                body = _encoded(text)
                held.append((i, t, *blocks(body)[:2]))
                size += len(body)
                if size >= CHUNK:
                    yield flush(held, f"{TaskContext.get().partitionId()}-{made}")
                    held, seen, size, made = [], set(), 0, made + 1
        if held:
            yield flush(held, f"{TaskContext.get().partitionId()}-{made}")

    def flush(held: list, chunk: str) -> pd.DataFrame:
        held.sort(key=lambda x: (x[0], x[1]))
        ids, texts = (np.array([x[c] for x in held], dtype=np.int64) for c in (0, 1))
        each = np.array([len(x[2]) for x in held])
        anchor, hashed = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        doc = np.repeat(np.arange(len(held)), each)
        # Equal blocks of the chunk: those after the least id are covered here, and go no further.
        both = anchor ^ scramble(hashed)
        order = np.argsort(both, kind="stable")
        new = np.r_[True, both[order][1:] != both[order][:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        covered = np.zeros(len(order), dtype=bool)
        covered[order] = (ids[doc[order]] > ids[doc[head]]) & (anchor[order] == anchor[head])
        at = np.flatnonzero(~covered)
        part = part_of(anchor[at], hashed[at], hot, parts)
        order = np.argsort(part, kind="stable")
        at, part = at[order], part[order]
        run_at = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[at][1:] != doc[at][:-1])][: len(at)])
        run_doc, run_n = doc[at[run_at]], np.diff(np.r_[run_at, len(at)])
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        rows = []
        for a, z in zip(starts, np.r_[starts, len(at)][1:], strict=True):
            runs = slice(*np.searchsorted(run_at, [a, z]))
            own, docs = at[a:z], run_doc[runs]
            rows.append(_packed(part=int(part[a]), chunk=chunk, ids=ids[docs], texts=None, docs=docs.astype(np.uint32), counts=run_n[runs].astype(np.uint32), low=anchor[own].astype(np.uint32), high=hashed[own]))
        which = np.arange(len(covered)) - np.repeat(np.cumsum(each) - each, each)
        local = np.bincount(doc[covered], minlength=len(held)).astype(np.uint32)
        rows.append(_packed(part=-1 - hash_of(chunk) % parts, chunk=chunk, ids=ids, texts=texts, docs=None, counts=None, low=which[covered].astype(np.uint32), high=local))
        return pd.DataFrame(rows, columns=DEALT_COLUMNS)

    return run


def hash_of(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=6).digest(), "little")


def settle_part(split: int, hot: np.ndarray):
    """The state of every block of a part; rows with what later steps need pass through.

    A part sees some of the blocks of a hot anchor, so those that are not covered are always split.
    """
    hot_low = np.unique(hot.astype(np.uint32))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf
        join = lambda c, kind: [np.frombuffer(x, dtype=kind) for x in pdf[c]]
        ids = np.concatenate([np.repeat(i, n) for i, n in zip(join("ids", np.int64), join("counts", np.uint32), strict=True)])
        lows = join("low", np.uint32)
        ends = [len(x) for x in lows]
        low, high = np.concatenate(lows), np.concatenate(join("high", _U))
        # By anchor (32 bits beside the part's), block, id.
        order = np.lexsort((ids, high, low))
        ids, low, high = ids[order], low[order], high[order]
        new_anchor = np.r_[True, low[1:] != low[:-1]]
        new_block = new_anchor | np.r_[True, high[1:] != high[:-1]]
        anchor, block = np.cumsum(new_anchor) - 1, np.cumsum(new_block) - 1
        least = np.minimum.reduceat(ids, np.flatnonzero(new_block))[block]
        starts = np.flatnonzero(new_anchor)
        kinds = np.add.reduceat(new_block, starts, dtype=np.int64)
        several = (kinds > 1) & (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts))
        open_state = np.where(several, np.where(kinds > split, SPLIT, WANTED), 0)
        state = np.empty(len(ids), dtype=np.uint8)
        open_state[is_in(low[starts], hot_low)] = SPLIT
        state[order] = np.where(ids > least, COVERED, open_state[anchor])
        stops = np.cumsum(ends)
        out = pdf[["part", "chunk", "docs", "counts"]].assign(low=[state[z - n : z].tobytes() for n, z in zip(ends, stops, strict=True)])
        return out.reindex(columns=DEALT_COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return run


def settle_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per document of a chunk the states of its blocks: those by part, and those that the chunk covered."""
    meta = pdf[pdf["part"] < 0].iloc[0]
    ids, texts = np.frombuffer(meta["ids"], dtype=np.int64), np.frombuffer(meta["texts"], dtype=np.int64)
    parts = pdf[pdf["part"] >= 0].sort_values("part")
    join = lambda c, kind: np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(x, dtype=kind) for x in parts[c])])
    doc, state = np.repeat(join("docs", np.uint32), join("counts", np.uint32)), join("low", np.uint8)
    state = state[np.argsort(doc, kind="stable")]
    n, local = np.bincount(doc, minlength=len(ids)), np.frombuffer(meta["high"], dtype=np.uint32).astype(np.int64)
    covered = np.frombuffer(meta["low"], dtype=np.uint32)
    ends, local_ends = np.cumsum(n), np.cumsum(local)
    rows = []
    for d in range(len(ids)):
        own = state[ends[d] - n[d] : ends[d]]
        if local[d] or own.any():
            rows.append((ids[d], texts[d], own.tobytes(), covered[local_ends[d] - local[d] : local_ends[d]].tobytes()))
    return pd.DataFrame(rows, columns=["id", "text_hash", "states", "covered"])


FOUND = "bin int, ids binary, texts binary, anchors binary, places binary, body binary"


def _intervals(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ascending intervals joined where they touch, as rows of start and end."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return np.stack([starts[new], ends[np.r_[new[1:], True]]], axis=1).astype(np.int64)


def open_blocks(parts: int, bins: int, hot: np.ndarray):
    """Per document the intervals that are covered already, and per bin the bytes of blocks and strings that are not settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen, size = [], set(), 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.id, row.text_hash) in seen:  # a row that repeats
                    continue
                seen.add((row.id, row.text_hash))
                body = _encoded(row.text)
                anchor, hashed, first, last, place = blocks(body)
                states = np.zeros(len(anchor), dtype=np.uint8)
                states[np.frombuffer(row.covered, dtype=np.uint32)] = COVERED
                rest = np.flatnonzero(states == 0)
                states[rest[np.argsort(part_of(anchor[rest], hashed[rest], hot, parts), kind="stable")]] = np.frombuffer(row.states, dtype=np.uint8)
                done, want, split = states == COVERED, np.flatnonzero(states == WANTED), np.flatnonzero(states == SPLIT)
                spans = _intervals(first[done], last[done] + SPAN - 1)
                bytes_of = [body[s:p] + body[p + GRAM : e + SPAN - 1] for s, p, e in zip(first[want], place[want], last[want], strict=True)]
                strings = [(body[i : i + SPAN], i, p - i) for s, p, e in zip(first[split].tolist(), place[split].tolist(), last[split].tolist(), strict=True) for i in range(s, e)]
                held.append((row.id, row.text_hash, spans, anchor[want], first[want], place[want] - first[want], last[want] - first[want], bytes_of, strings))
                size += sum(map(len, bytes_of)) + 2 * SPAN * len(strings) + 64
                if size >= CHUNK:
                    yield flush(held)
                    held, seen, size = [], set(), 0
        if held:
            yield flush(held)

    def flush(held: list) -> pd.DataFrame:
        held = split_strings(held)
        rows = [_packed(bin=-1 - int(i) % bins, ids=np.array([i]), texts=np.array([t]), anchors=None, places=spans, body=None) for i, t, spans, *_ in held if len(spans)]
        each = [len(x[3]) for x in held]
        ids, texts = (np.repeat(np.array([x[c] for x in held], dtype=np.int64), each) for c in (0, 1))
        anchors = np.concatenate([x[3] for x in held])
        places = np.stack([np.concatenate([x[c] for x in held]) for c in (4, 5, 6)], axis=1).astype(np.int64)
        bodies = [b for x in held for b in x[7]]
        to = (scramble(anchors) % _U(bins)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]][: len(to)])
        for a, z in zip(starts, np.r_[starts, len(order)][1:], strict=True):
            own = order[a:z]
            rows.append(_packed(bin=int(to[own[0]]), ids=ids[own], texts=texts[own], anchors=anchors[own], places=places[own], body=b"".join(bodies[i] for i in own)))
        return pd.DataFrame(rows, columns=["bin", "ids", "texts", "anchors", "places", "body"])

    return run


def split_strings(held: list) -> list:
    """Documents of a chunk whose split strings became blocks of one string, named by their bytes; of equal ones, those of the least id."""
    least: dict[bytes, int] = {}
    for i, *_, strings in held:
        for x, _, _ in strings:
            if least.get(x, i) >= i:
                least[x] = i
    if not least:
        return held
    out = []
    for i, t, spans, anchor, first, place, n, bytes_of, strings in held:
        gone = np.array([at for x, at, _ in strings if least[x] < i], dtype=np.int64)
        own = [s for s in strings if least[s[0]] == i]
        if len(gone):
            spans = _intervals(np.r_[spans[:, 0], gone], np.r_[spans[:, 1], gone + SPAN])
        names = np.array([xxhash.xxh64_intdigest(x) for x, _, _ in own], dtype=_U)
        more = [np.array([s[c] for s in own], dtype=np.int64) for c in (1, 2)]
        rest = [x[:p] + x[p + GRAM :] for x, _, p in own]
        out.append((i, t, spans, np.r_[anchor, names], np.r_[first, more[0]], np.r_[place, more[1]], np.r_[n, np.ones(len(own), dtype=np.int64)], bytes_of + rest))
    return out


def equal_strings(symbols: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which strings of REACH symbols, by their starts, are equal to one of a smaller id."""
    is_start = np.full(len(symbols), -1, dtype=np.int64)
    is_start[starts] = np.arange(len(starts))
    ordered = is_start[suffix_array(symbols)]
    ordered = ordered[ordered >= 0]
    views = np.lib.stride_tricks.sliding_window_view(symbols, REACH)[starts[ordered]]
    new = np.flatnonzero(np.r_[True, (views[1:] != views[:-1]).any(axis=1)])
    least = np.repeat(np.minimum.reduceat(ids[ordered], new), np.diff(np.r_[new, len(ordered)]))
    out = np.zeros(len(starts), dtype=bool)
    out[ordered] = ids[ordered] > least
    return out


def string_hashes(body: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` bytes, by doubling."""
    rolled, own, out, made = body.astype(_U) + _U(1), 1, None, 0
    while True:
        if width & own:
            if out is None:
                out, made = rolled.copy(), own
            else:
                n = len(body) - made - own + 1
                out = out[:n] * _U(pow(_BASE, own, 1 << 64))
                out += rolled[made : made + n]
                made += own
        if own * 2 > width:
            return out
        longer = rolled[:-own] * _U(pow(_BASE, own, 1 << 64))
        longer += rolled[own:]
        rolled, own = longer, own * 2


def may_repeat(anchors: np.ndarray, ids: np.ndarray, places: np.ndarray, offset: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Blocks with a string whose hash a block of another id has too: no other block can hold an equal string.

    About half of the blocks fall out before the suffix arrays are built.
    """
    rolled = string_hashes(body, REACH - 1)
    strings = places[:, 2]
    block = np.repeat(np.arange(len(strings)), strings)
    nth = _ramp(strings)
    key = scramble(rolled[offset[block] + nth])
    del rolled
    key ^= scramble(anchors[block] + (places[block, 1] - nth).astype(_U))
    del nth
    order = np.argsort(key)
    start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    own = ids[block[order]]
    several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    out = np.zeros(len(strings), dtype=bool)
    out[block[order][np.repeat(several, np.diff(np.r_[start, len(order)]))]] = True
    return out


def combine(ids: np.ndarray, anchors: np.ndarray, places: np.ndarray, offset: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each block the one that stands for it: of those that are equal byte by byte, the first of the least id."""
    data, kinds = body.tobytes(), {}
    spots = zip(anchors.tolist(), places[:, 1].tolist(), offset.tolist(), (offset + places[:, 2] + REACH - 2).tolist(), strict=True)
    kind = np.array([kinds.setdefault((anchor, place, data[a:z]), len(kinds)) for anchor, place, a, z in spots], dtype=np.int64)
    order = np.lexsort((ids, kind))
    return order[np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]])][kind]


def settle_bin(most: int):
    """Intervals of documents that the suffix arrays of a bin cover, of ``most`` symbols each where anchors allow; known intervals pass through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "text_hash", "spans"]
        if pdf["bin"].iloc[0] < 0:
            pick = lambda c: [np.frombuffer(x, dtype=np.int64)[0] for x in pdf[c]]
            return pd.DataFrame({"id": pick("ids"), "text_hash": pick("texts"), "spans": list(pdf["places"])}, columns=columns)
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), dtype=kind)
        ids, texts, anchors = join("ids", np.int64), join("texts", np.int64), join("anchors", _U)
        places = join("places", np.int64).reshape(-1, 3)
        body = join("body", np.uint8)
        # A block's symbols: the bytes before its anchor, the anchor, the bytes after, then a divider.
        length = places[:, 2] + REACH - 1
        offset = np.cumsum(length - 1) - (length - 1)
        out = []
        head = combine(ids, anchors, places, offset, body)
        covered = ids > ids[head]
        if covered.any():
            begin = places[covered, 0]
            out.append(np.stack([ids[covered], texts[covered], begin, begin + places[covered, 2] + SPAN - 1], axis=1))
        # One copy of a block goes into the array; what is found in it holds for every copy of its id.
        copies = np.flatnonzero(~covered)
        copies = copies[np.argsort(head[copies], kind="stable")]
        copied = head[copies]
        fine = np.flatnonzero(may_repeat(anchors, ids, places, offset, body) & (head == np.arange(len(head))))
        order = fine[np.argsort(anchors[fine], kind="stable")]
        for own in arrays_of(order, anchors, length, most):
            block, nth = array_strings(own, ids, anchors, places, length, offset, body)
            if len(block):
                # Strings of one block overlap, so those from its first to its last are one interval.
                start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                first, last = nth[start], nth[np.r_[start[1:], len(nth)] - 1]
                at, stop = (np.searchsorted(copied, block[start], side=x) for x in ("left", "right"))
                each = stop - at
                copy = copies[np.repeat(at, each) + _ramp(each)]
                begin, end = (places[copy, 0] + np.repeat(x, each) for x in (first, last + SPAN))
                out.append(np.stack([ids[copy], texts[copy], begin, end], axis=1))
        rows = []
        if out:
            found = np.concatenate(out)
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            starts = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)])
            for own in np.split(found, starts[1:]):
                rows.append((own[0, 0], own[0, 1], _intervals(own[:, 2], own[:, 3]).tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return run


def arrays_of(order: np.ndarray, anchors: np.ndarray, length: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Blocks in order of anchors, cut before anchors such that a cut has ``most`` symbols or one anchor."""
    if not len(order):
        return
    total = np.r_[0, np.cumsum(length[order] + 1)]
    heads = np.flatnonzero(np.r_[True, anchors[order][1:] != anchors[order][:-1]])
    stops = np.r_[heads[1:], len(order)]
    at = 0
    while at < len(order):
        fits = np.searchsorted(total[stops], total[at] + most, side="right") - 1
        to = max(int(stops[fits]) if fits >= 0 else 0, int(stops[np.searchsorted(stops, at, side="right")]))
        yield order[at:to]
        at = to


def array_strings(own: np.ndarray, ids: np.ndarray, anchors: np.ndarray, places: np.ndarray, length: np.ndarray, offset: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, number of the string in it) of the strings that one suffix array of these blocks covers."""
    names = 257 + np.cumsum(np.r_[True, anchors[own][1:] != anchors[own][:-1]])
    start = np.cumsum(length[own] + 1) - (length[own] + 1)
    symbols = np.zeros(int((length[own] + 1).sum()), dtype=np.int32)
    anchor_at = start + places[own, 1]
    filled = np.repeat(start, length[own]) + _ramp(length[own])
    is_anchor = np.zeros(len(symbols), dtype=bool)
    is_anchor[anchor_at] = True
    filled = filled[~is_anchor[filled]]
    symbols[filled] = body[np.repeat(offset[own], length[own] - 1) + _ramp(length[own] - 1)].astype(np.int32) + 1
    symbols[anchor_at] = names
    strings = places[own, 2]
    which = np.repeat(np.arange(len(own)), strings)
    nth = _ramp(strings)
    covered = equal_strings(symbols, start[which] + nth, ids[own][which])
    return own[which[covered]], nth[covered]


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``id`` as a long: as it is where it is a whole number, else its rank among the ids."""
    if isinstance(rows.schema["id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return rows.withColumn("number", F.col("id").cast("long"))
    ranks = materialize(in_order(rows.select("id").where("id IS NOT NULL").distinct(), ["id"], rank="number"), "ranks")
    return rows.join(ranks.withColumnRenamed("id", "ranked"), F.col("id") == F.col("ranked"), "left").drop("ranked")


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", split: int = SPLIT_BLOCKS, sample: int = SAMPLE, sample_hot: int = SAMPLE_HOT) -> DataFrame:
    """(doc, key, text, spans): the row of ``docs``, its key and text, and blobs of the byte intervals to remove, or null."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.col(text).alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("doc"),
    )
    rows = numbered(rows).withColumnRenamed("id", "key").withColumnRenamed("number", "id")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / max(PART, math.sqrt(total * 512.0))))
    long_enough = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= SPAN)).select("id", "text_hash", "text")
    hot = hot_anchors(long_enough, sample, sample_hot)
    dealt = long_enough.mapInPandas(released_each(cut_chunks(parts, hot)), DEALT)
    settled = dealt.groupBy("part").applyInPandas(released(settle_part(split, hot)), DEALT)
    states = settled.groupBy("chunk").applyInPandas(released(settle_chunk), "id long, text_hash long, states binary, covered binary")
    # Rows that repeat have a state each, of which any will do.
    states = materialize(states.groupBy("id", "text_hash").agg(F.max_by(F.struct("states", "covered"), F.struct("states", "covered")).alias("x")).select("id", "text_hash", "x.*"), "blocks")
    # Both joins read the same columns of ``rows``, so that its exchange is made once and used again.
    opened = rows.join(states, ["id", "text_hash"]).select("id", "text_hash", "key", "text", "doc", "states", "covered").mapInPandas(released_each(open_blocks(parts, parts, hot)), FOUND)
    spans = opened.groupBy("bin").applyInPandas(released(settle_bin(ARRAY)), "id long, text_hash long, spans binary")
    spans = spans.groupBy("id", "text_hash").agg(F.collect_list("spans").alias("spans"))
    return rows.join(spans, ["id", "text_hash"], "left").select("doc", F.col("key").alias("id"), "text", "spans")


def remove(body: bytes, blobs: list[bytes] | None) -> tuple[np.ndarray, bytes]:
    """Maximal removed intervals, and the bytes that stay."""
    if blobs is None or not len(blobs):
        return np.zeros((0, 2), dtype=np.int64), body
    spans = np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 2)
    spans = _intervals(spans[:, 0], spans[:, 1])
    edges = [0, *spans.reshape(-1).tolist(), len(body)]
    return spans, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


REMOVED = "n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """Per row its key, n_bytes, n_removed, removed (byte spans) and kept (the bytes that stay). ``limits`` are those of ``with_spans``."""

    @F.pandas_udf(REMOVED)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, blobs in batches:
            out = []
            for x, b in zip(texts, blobs, strict=True):
                body = _encoded(x)
                spans, kept = remove(body, b)
                out.append((len(body), len(body) - len(kept), [tuple(s) for s in spans.tolist()], kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "removed", "kept"])
        release_memory()

    found = with_spans(docs.select(key, text), key, text, **limits)
    return found.select(F.col("id").alias(key), of(F.col("text"), F.col("spans")).alias("x")).select(key, "x.*")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; rows of which nothing stays are left out.

    Characters that a cut goes through are dropped, as the text must stay UTF-8.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, blobs in batches:
            yield pd.Series([x if b is None else remove(_encoded(x), b)[1].decode("utf-8", "ignore") for x, b in zip(texts, blobs, strict=True)], dtype=object)
        release_memory()

    rest = with_spans(docs, key, text).select("doc", "spans", F.col("text").alias("before"), of(F.col("text"), F.col("spans")).alias("after"))
    rest = rest.where(F.col("spans").isNull() | (F.col("after") != ""))
    return rest.select(*[F.col("after").alias(c) if c == text else F.col(f"doc.{c}") for c in docs.columns])


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op7_repeated_passages": op7_repeated_passages}
ORACLE: dict[str, str] = {}
