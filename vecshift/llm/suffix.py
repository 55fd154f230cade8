"""Suffix-array de-duplication by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (at a smaller id, or earlier in
the same document). The work is in five steps, none of which holds all suffixes in one task:

1. Anchors. Every window of ``length`` bytes has one: the first of its least hashed ``GRAM``-byte strings. Equal
   windows have equal anchors at equal places, so windows need comparing only where their anchors' hashes are
   equal. Neighbouring windows with one anchor form a segment.
2. Segments meet by anchor hash. One that stands alone is not repeated; one whose whole content stands
   earlier is repeated throughout (copies within a task's batch are settled before the shuffle). What remains is
   the first segment of each content among several under one hash.
3. Their bytes are fetched. A window has ``length - GRAM`` bytes beside its anchor, at least half of them on one
   side, and equal windows have the same ones there: segments are dealt out by hash, side and the half nearest the
   anchor, each time with the windows of that side. Who is alone there has no window in common with any; those
   of a very frequent key are dealt to chunks.
4. Each task builds suffix arrays and Burrows-Wheeler transforms of shards of its segments and merges them by
   interleave refinement: the transforms lead from each suffix to the one that is h symbols longer, so the
   interleave of the shards by the first h symbols gives that by 2 h in one stable pass, and two neighbours that
   part in a round have a common prefix shorter than that round's. No suffix is compared or sorted again. Intervals
   with a common prefix of ``length`` are the repeated strings; all but an interval's first place are marked. Chunks of one key meet once more on the contents of their first places.
5. The marks of a document, as ranges of windows, cut its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small, whole_text

GRAM = 32
#: Bytes that are hashed at once, and bytes of segments that one merge holds and one of its shards.
HASH_BLOCK, MERGE_BLOCK, SHARD = 1 << 20, 1 << 21, 1 << 19
#: Segments of one key in one task.
CHUNK = 8192
POS_BITS = 40
NO_ID = (1 << 63) - 1
U = np.uint64
MASK, HIGH = (1 << 64) - 1, 1 << 63


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of concatenations, from the hashes of their parts."""
    return _mixed(a * U(0xD6E8FEB86659FD93) + b)


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts that end at ``ends``: first window, number of windows, anchor, anchor hash, content hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U), none.astype(U)
    h = {1: _mixed(data.astype(U) + U(0xA0761D6478BD642F))}
    size = 1
    while size < GRAM or 2 * size <= length:
        part = h[size]
        h[2 * size] = _joined(part[:-size], part[size:])
        size *= 2
    whole, done = None, 0
    for size in sorted(h, reverse=True):
        while done + size <= length:
            part = h[size][done:]
            whole = part if whole is None else _joined(whole[:len(part)], part[:len(whole)])
            done += size
    n_windows = n - length + 1
    whole = whole[:n_windows]
    gram = h[GRAM]
    keyed = (_mixed(gram) & ~U((1 << 24) - 1)) | np.arange(len(gram), dtype=U)
    span, reach = length - GRAM + 1, 1  # grams of a window
    while 2 * reach <= span:
        keyed = np.minimum(keyed[:-reach], keyed[reach:])
        reach *= 2
    if span > reach:
        keyed = np.minimum(keyed[:len(keyed) - (span - reach)], keyed[span - reach:])
    anchor = (keyed & U((1 << 24) - 1)).astype(np.int64)[:n_windows]
    inside = np.ones(n_windows, bool)  # windows that cross no end of a text
    edge = np.zeros(n + 1, np.int64)
    cut = ends[ends < n]
    np.add.at(edge, np.maximum(cut - length + 1, 0), 1)
    np.add.at(edge, cut, -1)
    inside = np.cumsum(edge)[:n_windows] == 0
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none.astype(U), none.astype(U)
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)))
    first = at[new]
    count = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    a = anchor[first]
    content = _joined(_joined(whole[first], whole[first + count - 1]), ((a - first) * 4096 + count).astype(U))
    return first, count, a, gram[a], content


def merged(ids: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, with those that touch made one."""
    if not len(ids):
        return ids, pos, n
    order = np.lexsort((pos, ids))
    ids, pos, n = ids[order], pos[order], n[order]
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & ((pos[1:] >> POS_BITS) == (pos[:-1] >> POS_BITS))
    text = np.cumsum(~same) << POS_BITS  # one number line, a stretch for each text
    at = text + (pos & ((1 << POS_BITS) - 1))
    most = np.maximum.accumulate(at + n)
    new = np.ones(len(ids), bool)
    new[1:] = ~same[1:] | (at[1:] > most[:-1])
    start = np.flatnonzero(new)
    last = np.concatenate((start[1:], [len(ids)])) - 1
    return ids[start], pos[start], most[last] - at[start]


ROW = "pk bigint, h bigint, content bigint, id bigint, pos bigint, n bigint, lead int"


def _rows(pk: np.ndarray, h: np.ndarray, content: np.ndarray, ids: np.ndarray, pos: np.ndarray, n: np.ndarray, lead: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"pk": pk, "h": h, "content": content, "id": ids, "pos": pos, "n": n, "lead": lead.astype(np.int32)})


def _anchor_rows(texts: Iterable[tuple[int, int, bytes]], length: int) -> Iterator[pd.DataFrame]:
    """Rows of one batch: a segment (lead >= 0) for each content, marks (lead -1) for its repeats in the batch."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def settle() -> pd.DataFrame:
        h, content, ids, pos, n, lead = (np.concatenate([x[i] for x in held]) for i in range(6))
        order = np.lexsort((pos, ids, content, h))
        h, content, ids, pos, n, lead = h[order], content[order], ids[order], pos[order], n[order], lead[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (content[1:] == content[:-1])
        i, p, k = merged(ids[again], pos[again], n[again])
        zero = np.zeros(len(i), np.int64)
        spread = _joined(i.view(U), p.view(U)).view(np.int64)
        one = ~again
        return pd.concat([_rows(h[one], h[one], content[one], ids[one], pos[one], n[one], lead[one]),
                          _rows(spread, zero, zero, i, p, k, zero - 1)], ignore_index=True)

    pending: list[tuple[int, int, bytes]] = []

    def hashed() -> None:
        data = np.frombuffer(b"".join(t for _, _, t in pending), np.uint8)
        sizes = np.array([len(t) for _, _, t in pending], np.int64)
        ends = np.cumsum(sizes)
        first, count, anchor, h, content = segments(data, ends, length)
        owner = np.searchsorted(ends, first, side="right")
        start = ends - sizes
        ids = np.array([i for i, _, _ in pending], np.int64)[owner]
        pos = np.array([p for _, p, _ in pending], np.int64)[owner] + first - start[owner]
        held.append((h.view(np.int64), content.view(np.int64), ids, pos, count.astype(np.int64), anchor - first))
        pending.clear()

    for i, copy, t in texts:
        # a text longer than a block goes on in the next one, from the first window not yet seen
        for at in range(0, max(len(t) - length + 1, 0), HASH_BLOCK):
            part = t[at:at + HASH_BLOCK + length - 1]
            pending.append((i, (copy << POS_BITS) + at, part))
            size += len(part)
            if size >= HASH_BLOCK:
                hashed()
                size = 0
    if pending:
        hashed()
    if held:
        yield settle()


def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by hash, content and place: repeats become marks, and of contents that differ under one hash the first segments go on.

    Output: marks with ``lead`` -1, segments to compare with their own. The state is one row, however long a run is.
    """
    last: tuple[int, int] | None = None
    waiting: pd.DataFrame | None = None  # the first row of the last run, while it is alone in content
    for b in batches:
        passed, b = b[b["lead"] < 0], b[b["lead"] >= 0]
        if len(passed):
            yield passed
        if not len(b):
            continue
        h, content = b["h"].to_numpy(), b["content"].to_numpy()
        new_h, new_content = np.ones(len(b), bool), np.ones(len(b), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_content[1:] = new_h[1:] | (content[1:] != content[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            new_content[0] = new_h[0] or content[0] != last[1]
        other = new_content & ~new_h  # a further content under the same hash
        run = np.cumsum(new_h)  # 0: the run of the batch before
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[other]] = True
        out = [b[other | (new_h & mixed[run])]]
        again = b[~new_content]
        if len(again):
            out.append(again.assign(lead=np.int32(-1)))
        if mixed[0] and waiting is not None:
            out.append(waiting)
            waiting = None
        if run[-1] > 0:
            at = np.flatnonzero(new_h)[-1]
            waiting = None if mixed[-1] else b.iloc[at:at + 1]
        last = (int(h[-1]), int(content[-1]))
        yield pd.concat(out, ignore_index=True)


class Transform:
    """Suffix order and Burrows-Wheeler transform of a shard of strings, each ended by its own mark (symbol 0)."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        n = int(sizes.sum())
        end = np.cumsum(sizes) - 1
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[end] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        stop = np.repeat(end, sizes)  # the end mark after each place
        place = np.arange(n)
        key, known = text.copy(), 5
        for k in range(1, known):
            key = key * 257 + np.where(place + k <= stop, text[np.minimum(place + k, n - 1)], 0)
        longest = int(sizes.max(initial=1))
        order = _stable_order(key, 257 ** known)
        rank = _dense(key, order)
        while known < longest and rank.max(initial=0) + 1 < n:
            key = rank * (n + 1) + np.where(place + known <= stop, rank[np.minimum(place + known, n - 1)] + 1, 0)
            order = _stable_order(key, (n + 1) ** 2)
            rank = _dense(key, order)
            known *= 2
        start = end - sizes + 1
        before = np.concatenate(([0], text[:-1]))
        before[start] = 0
        self.bwt = before[order].astype(np.uint16)
        self.string = np.repeat(np.arange(len(strings)), sizes)[order]
        self.offset = order - start[self.string]
        self.n_strings = len(strings)

    def longer(self) -> np.ndarray:
        """For each row the row of the suffix that is one symbol longer (-1: the suffix is a whole string)."""
        out = np.full(len(self.bwt), -1, np.int64)
        real = np.flatnonzero(self.bwt)
        out[real[np.argsort(self.bwt[real], kind="stable")]] = self.n_strings + np.arange(len(real))
        return out


def _stable_order(key: np.ndarray, limit: int) -> np.ndarray:
    """Places in the order of ``key`` (under ``limit``), equal keys in the order of places."""
    bits = max(len(key) - 1, 1).bit_length()
    if limit << bits >= 1 << 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
    return rank


def interleave(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: the rows of all shards (numbered shard after shard) in the order of their suffixes' first
    ``depth`` symbols, and for each whether it has less than these in common with the row before it.

    Round h has all rows ordered by h symbols, in blocks of rows that agree on them. Taken in that order, each row
    leads to that of the suffix that is ``step`` symbols longer; a stable pass puts these into their blocks, and so
    into the order of h + step symbols. Rows of one shard never change their order: only the interleave is
    refined. End marks stand first, all distinct, in the order of shards.
    """
    sizes = [len(s.bwt) for s in shards]
    n = sum(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    base = np.cumsum([0, *sizes[:-1]])
    one = np.concatenate([np.where((x := s.longer()) >= 0, x + at, -1) for s, at in zip(shards, base)])
    first = np.concatenate([np.concatenate((np.zeros(s.n_strings, np.uint16), np.sort(s.bwt[s.bwt > 0]))) for s in shards])
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (first[order][1:] == 0)
    block = np.empty(n, np.int64)
    block[order] = np.cumsum(new) - 1
    h, jumps = 1, {1: one}

    def jump(step: int) -> np.ndarray:
        """Leads ``step`` symbols on, put together from the powers of two known so far."""
        if step not in jumps:
            power = 1 << (step.bit_length() - 1)
            a, b = (jump(power // 2), jump(power // 2)) if power == step else (jump(power), jump(step - power))
            jumps[step] = np.where(a >= 0, b[np.maximum(a, 0)], -1)
        return jumps[step]

    while h < depth and not new.all():
        step = min(h, depth - h)
        reached = jump(step)[order]
        real = reached >= 0
        # suffixes of fewer than ``step`` symbols are led to by none; an end mark has set each apart
        short = np.ones(n, bool)
        short[reached[real]] = False
        go = np.concatenate((np.flatnonzero(short), reached[real]))
        rest = np.concatenate((np.full(len(go) - int(real.sum()), -1), block[order][real]))
        into = _stable_order(block[go], n)
        order, rest = go[into], rest[into]
        b = block[order]
        new[1:] = (b[1:] != b[:-1]) | (rest[1:] != rest[:-1])
        block = np.empty(n, np.int64)
        block[order] = np.cumsum(new) - 1
        h += step
    return order, new


def repeated_windows(strings: list[bytes], windows: np.ndarray, ids: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the first ``windows[i]`` windows of each string i, placed at (ids[i], pos[i] ...): which repeat an earlier one.

    Returns (string, offset) of the repeats and of the first places of repeated or single windows.
    """
    cut, size = [0], 0
    for i, s in enumerate(strings):
        if size and size + len(s) > SHARD:
            cut.append(i)
            size = 0
        size += len(s) + 1
    cut.append(len(strings))
    shards = [Transform(strings[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    row, parts = interleave(shards, length)
    string = np.concatenate([s.string + a for s, a in zip(shards, cut)])[row]
    offset = np.concatenate([s.offset for s in shards])[row]
    interval = np.cumsum(parts)
    real = offset < windows[string]
    string, offset, interval = string[real], offset[real], interval[real]
    order = np.lexsort((pos[string] + offset, ids[string], interval))
    string, offset, interval = string[order], offset[order], interval[order]
    again = np.zeros(len(string), bool)
    again[1:] = interval[1:] == interval[:-1]
    return string[again], offset[again], string[~again], offset[~again]


def _sides(h: int, pos: int, n: int, lead: int, data: bytes, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(key, position, windows, bytes)`` of the windows of a segment with at least half of what is beside the anchor to its left, and of the others."""
    half = (length - GRAM) // 2
    left = min(lead - half + 1, n)  # windows 0 ... left - 1 have at least half on the left
    if left > 0:
        yield xxhash.xxh64_intdigest(data[lead - half:lead], (2 * h) & MASK) - HIGH, pos, left, data[:left + length - 1]
    left = max(left, 0)
    if left < n:
        yield xxhash.xxh64_intdigest(data[lead + GRAM:lead + GRAM + half], (2 * h + 1) & MASK) - HIGH, pos + left, n - left, data[left:]


def _compare_block(b: pd.DataFrame, length: int) -> pd.DataFrame:
    """Marks of the repeated windows of a block, and for keys dealt to chunks the first places with a digest of their content."""
    out = pd.DataFrame({"id": pd.Series(dtype="int64"), "pos": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "digest": pd.Series(dtype=object)})
    # sorted by key: who is alone under a key of one chunk has nothing in common with any
    key, part = b["key"].to_numpy(), b["part"].to_numpy()
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    keep = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])) | (b["chunks"].to_numpy() > 1))
    if not len(keep):
        return out
    b = b.iloc[keep]
    ids, pos, n = (b[c].to_numpy(np.int64) for c in ("id", "pos", "n"))
    strings, chunked = [bytes(s) for s in b["data"]], b["chunks"].to_numpy() > 1
    s, o, fs, fo = repeated_windows(strings, n, ids, pos, length)
    i, p, k = merged(ids[s], pos[s] + o, np.ones(len(s), np.int64))
    parts = [pd.DataFrame({"id": i, "pos": p, "n": k, "digest": None})]
    far = chunked[fs]
    if far.any():
        fs, fo = fs[far], fo[far]
        digest = [hashlib.blake2b(strings[x][y:y + length], digest_size=16).digest() for x, y in zip(fs.tolist(), fo.tolist())]
        parts.append(pd.DataFrame({"id": ids[fs], "pos": pos[fs] + fo, "n": np.ones(len(fs), np.int64), "digest": digest}))
    return pd.concat(parts, ignore_index=True)


def cut_text(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left, for ranges (first window, windows) that are marked."""
    edge = np.zeros(len(data) + 1, np.int64)
    for p, n in ranges:
        edge[p] += 1
        edge[min(p + n + length - 1, len(data))] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_text (binary), kept_sha256`` for every row of ``docs``.

    Integer ids; ``length`` at least 64. Null texts are empty; texts shorter than ``length`` lose nothing. Null ids are the last
    document. Rows that repeat an id and a text are one document and get equal results; further texts of an id
    follow its first as parts of one document, in the order of their hashes. Other columns are not read.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), whole_text(text_col).alias("text"))
    counted = mine.select("id", F.xxhash64("text").alias("digest")).groupBy("id").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("digest")).alias("digests"))
    twice = materialize(counted.filter("rows > 1"), "suffix-twice")
    n_twice = twice.count()
    if n_twice:
        known = small(twice.select(F.col("id").alias("id_"), "digests"), n_twice)
        part = F.coalesce(F.array_position("digests", F.xxhash64("text")) - 1, F.lit(0))
        mine = mine.join(known, F.col("id") == F.col("id_"), "left").select("doc_id", "id", part.cast("bigint").alias("part"), "text", F.col("id_").isNotNull().alias("again"))
        distinct = mine.filter("not again").unionByName(mine.filter("again").dropDuplicates(["id", "part"]))
    else:
        distinct = mine = mine.withColumn("part", F.lit(0).cast("bigint"))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _anchor_rows(((i, p, t.encode("utf-8", "replace")) for i, p, t in zip(b["id"], b["part"], b["text"])), length)

    rows = distinct.filter(F.octet_length("text") >= length).select("id", "part", "text").mapInPandas(anchors, ROW)
    order = ["pk", "h", "content", "id", "pos"]
    met = materialize(rows.repartition("pk").sortWithinPartitions(*order).mapInPandas(meet, ROW).drop("pk", "content"), "suffix-met")
    marks = [met.filter("lead < 0").select("id", "pos", "n")]

    # the bytes of the segments to compare, from their documents
    place = F.shiftright("pos", POS_BITS)
    wanted = met.filter("lead >= 0")
    per_doc = wanted.groupBy(F.col("id").alias("id_"), place.alias("part_")).agg(F.collect_list(F.struct("h", "pos", "n", "lead")).alias("ws"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = (1 << POS_BITS) - 1
        for b in batches:
            out = []
            for i, t, ws in zip(b["id"], b["text"], b["ws"]):
                data = t.encode("utf-8", "replace")
                for w in ws:
                    at = w["pos"] & low
                    for key, pos, n, part in _sides(w["h"], w["pos"], w["n"], w["lead"], data[at:at + w["n"] + length - 1], length):
                        out.append((key, i, pos, n, part))
            yield pd.DataFrame(out, columns=["key", "id", "pos", "n", "data"])

    fetched = (distinct.select("id", "part", "text").join(per_doc, (F.col("id") == F.col("id_")) & (F.col("part") == F.col("part_")))
               .select("id", "text", "ws").mapInPandas(fetch, "key bigint, id bigint, pos bigint, n bigint, data binary"))
    fetched = materialize(fetched, "suffix-segments")
    sizes = fetched.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > chunk)
    sizes = materialize(sizes.select(F.col("key").alias("hot"), F.ceil(F.col("size") / chunk).alias("of")), "suffix-hot")
    chunks = F.coalesce("of", F.lit(1)).cast("bigint")
    dealt = fetched.join(small(sizes), F.col("key") == F.col("hot"), "left").select(
        "key", "id", "pos", "n", "data", chunks.alias("chunks"), F.pmod(F.xxhash64("id", "pos"), chunks).alias("part"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += int(b["data"].str.len().sum())
            if size >= MERGE_BLOCK:
                whole = pd.concat(held, ignore_index=True)
                last = ((whole["key"] == whole["key"].iloc[-1]) & (whole["part"] == whole["part"].iloc[-1])).to_numpy()
                first = int(np.argmax(last))  # a key's segments stay together
                if first:
                    yield _compare_block(whole.iloc[:first].reset_index(drop=True), length)
                held = [whole.iloc[first:]]
                size = int(held[0]["data"].str.len().sum())
        if held:
            yield _compare_block(pd.concat(held, ignore_index=True), length)

    compared = (dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id", "pos")
                .mapInPandas(compare, "id bigint, pos bigint, n bigint, digest binary"))
    compared = materialize(compared, "suffix-compared")
    marks.append(compared.filter("digest is null").select("id", "pos", "n"))
    # first places of one content in several chunks: at most one a chunk
    firsts = compared.filter("digest is not null").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("id", "pos"))).alias("at"))
    marks.append(firsts.select(F.explode(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1)))).alias("x")).select("x.id", "x.pos", F.lit(1).cast("bigint").alias("n")))

    every = marks[0].unionByName(marks[1]).unionByName(marks[2])
    start = F.col("pos").bitwiseAND(F.lit((1 << POS_BITS) - 1))
    ranges = every.groupBy(F.col("id").alias("id_"), place.alias("part_")).agg(F.collect_list(F.struct(start.alias("p"), "n")).alias("ranges"))

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_text binary, kept_sha256 string")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in parts:
            out = []
            for t, r in zip(texts, found):
                data = t.encode("utf-8", "replace")
                removed, runs, kept = cut_text(data, [(x["p"], x["n"]) for x in r], length) if r is not None and len(r) else (0, 0, data)
                out.append((len(data), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    found = mine.join(ranges, (F.col("id") == F.col("id_")) & (F.col("part") == F.col("part_")), "left")
    return found.select("doc_id", clean("text", "ranges").alias("c")).select("doc_id", "c.*")
