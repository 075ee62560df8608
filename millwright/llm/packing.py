"""Documents as token sequences of a bounded length, packed by best fit and a local search of swaps.

``pieces`` tokenizes: a document is its token ids and an end id; only longer ones are cut, into pieces of the full
length (the last may be shorter). ``pack`` deals the shorter pieces out in even parts, of a size that one task holds, and
fills sequences in each: best fit, longest first, then a local search between underfull sequences. It moves one piece, or
exchanges one for one, two for one or one for two, from an emptier sequence to a fuller one, so that the sum of squared
fills grows with every step; it ends when no step is left or the sequences are as few as the tokens allow. A part leaves at
most about one underfull sequence more than a packing of everything at once.

Cases: a NULL text counts as empty, which gives one piece, the end id. Equal documents and repeated keys are packed one by
one. A document of any length is cut whole. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import written

#: Pieces in one part: the search of a part takes some ten seconds where its pieces fit badly.
PART = 15_000
#: Distinct words of a generation that a worker remembers the ids of (some 100 MB).
REMEMBERED = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Tokens:
    """Token ids as little-endian bytes, word by word, as no token of the vocabulary spans a blank.

    Only blanks, tabs and line ends cut words here; other white space is left to the tokenizer. Marks after a letter
    are cut off as well, as the vocabulary's pattern parts letters from them, and ASCII words are lower-cased, as it does.
    Ids are remembered for as long as a worker lives, in two generations of at most ``REMEMBERED`` words.
    """

    MARKS = ".,;:!?*$#%&|"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.closes[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.cores: list[dict[str, bytes]] = [{}, {}]

    @classmethod
    def of_worker(cls, path: str) -> "_Tokens":
        import tokenizers

        held = tokenizers.__dict__.setdefault("_remembered_by_path", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    @staticmethod
    def _room(generations: list[dict]) -> None:
        if len(generations[0]) > REMEMBERED:
            generations[1] = generations[0]
            generations[0] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        blank = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ") for x in texts]
        split = pc.split_pattern(pa.array(blank, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        ids, starts, counts = self._ids(words.dictionary.to_pylist())
        # Each word of the texts takes the ids of its entry.
        entry = words.indices.to_numpy()
        size = counts[entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.arange(total) + np.repeat(starts[entry] - (ends - size), size)]
        edges = np.r_[0, ends][split.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the words, one after another, with the start and the number of each."""
        self._room(self.words)
        known, older = self.words
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        if new:
            self._learn(new, known)
        found = [known[w] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts, counts

    def _learn(self, new: list[str], known: dict[str, bytes]) -> None:
        self._room(self.cores)
        cores, older = self.cores
        parts, unknown = [], {}
        for w in new:
            core, tail = (w, "") if w.isalpha() else (w.rstrip(self.MARKS), "")
            if len(core) < len(w):
                core, tail = (core, w[len(core) :]) if core and core[-1].isalpha() else (w, "")
            if core.isascii():
                core = core.lower()
            parts.append((core, tail))
            for c in (core, tail):
                if c not in cores and c not in unknown:
                    if c in older:
                        cores[c] = older[c]
                    else:
                        unknown[c] = None
        plain = [c for c in unknown if c.isalpha()]
        for i in range(0, len(plain), 4096):
            cores.update(self._together(plain[i : i + 4096]))
        rest = [c for c in unknown if c not in cores]
        for i in range(0, len(rest), 4096):
            cores.update(self._one_by_one(rest[i : i + 4096]))
        for w, (core, tail) in zip(new, parts):
            known[w] = cores[core] + cores[tail] if tail else cores[core]

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found)}

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters in one go, as a text of its own; cut where a token ends a word, which every word has one of or more.

        Where the vocabulary does not mark ends, or cuts one of the words, the numbers differ and they go one by one.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1 if len(ids) else ids
        if len(ends) != len(words) or ends[-1] != len(ids):
            if len(words) <= 64:
                return self._one_by_one(words)
            half = len(words) // 2  # one odd word does not slow the others down
            return self._together(words[:half]) | self._together(words[half:])
        data, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {w: data[a:b] for w, a, b in zip(words, edges[:-1], edges[1:])}


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 4096, end: int = 1) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32). ``tokenizer`` is a vocabulary file all tasks can open."""
    last = int(end).to_bytes(4, "little")
    step = 4 * length

    def run(batches):
        tokens = _Tokens.of_worker(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(keys), 256):
                rows: list[list] = [[], [], [], [], []]
                for k, ids in zip(keys[i : i + 256], tokens.encode([x or "" for x in texts[i : i + 256]])):
                    ids += last
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for column, value in zip(rows, (k, n, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Places of ``lengths`` by sequence: longest first, each into the fullest sequence that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room for exactly r
    for i in order.tolist():
        n = int(lengths[i])
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _step(source: int, owner: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int):
    """The step from one sequence to a fuller one that raises the sum of squared fills most, or None.

    That is (pieces given, target, pieces taken). Moves are looked at first, then exchanges of one for one, of two for
    one and of one for two; each kind over all pieces of all underfull sequences at once.
    """
    room = capacity - fill
    able = (fill >= fill[source]) & (room > 0)
    able[source] = False
    targets = np.flatnonzero(able)
    if not len(targets):
        return None
    own = np.flatnonzero(owner == source)
    size, first = np.unique(lengths[own], return_index=True)
    single = [(int(n), own[i : i + 1]) for n, i in zip(size, first)]

    def best(gifts: list, takes: np.ndarray, at: np.ndarray):
        found, worth, r, ahead = None, 0, room[at], fill[at] - fill[source]
        for given, members in gifts:
            gain = given - takes
            raised = np.where((gain > 0) & (gain <= r), gain * (ahead + gain), 0)
            k = int(raised.argmax()) if len(raised) else 0
            if len(raised) and raised[k] > worth:
                found, worth = (members, int(at[k]), k), int(raised[k])
        return found

    nothing = np.empty(0, np.int64)
    found = best(single, np.zeros(len(targets), np.int64), targets)
    if found:
        return found[0], found[1], nothing
    pieces = np.flatnonzero(able[owner])
    pieces = pieces[np.argsort(owner[pieces], kind="stable")]
    at = owner[pieces]
    found = best(single, lengths[pieces], at)
    if found is None and len(own) > 1:
        pairs = {int(lengths[own[i]] + lengths[own[j]]): own[[i, j]] for i in range(len(own)) for j in range(i)}
        found = best(list(pairs.items()), lengths[pieces], at)
    if found:
        return found[0], found[1], pieces[found[2] : found[2] + 1]
    for apart in range(1, len(pieces)):  # pairs of a sequence's pieces, so many places from one another
        pair = np.flatnonzero(at[apart:] == at[:-apart])
        if not len(pair):
            return None
        found = best(single, lengths[pieces[pair]] + lengths[pieces[pair + apart]], at[pair])
        if found:
            return found[0], found[1], pieces[[pair[found[2]], pair[found[2]] + apart]]
    return None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least full of ``bins`` by moves and exchanges that raise the sum of squared fills.

    A piece only ever goes to a sequence that is at least as full, so every step raises that sum. The search sweeps over all
    sequences from the emptiest on until a sweep finds no step, or the sequences are as few as the tokens allow.
    """
    least = -(-int(lengths.sum()) // capacity)
    owner = np.empty(len(lengths), np.int64)
    for b, members in enumerate(bins):
        owner[members] = b
    fill = np.bincount(owner, lengths, len(bins)).astype(np.int64)
    live, moved = len(bins), True
    while moved and live > least:
        moved = False
        for source in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[source] < capacity and live > least:
                step = _step(source, owner, fill, lengths, capacity)
                if step is None:
                    break
                given, target, taken = step
                gain = int(lengths[given].sum() - lengths[taken].sum())
                owner[given], owner[taken] = target, source
                fill[target] += gain
                fill[source] -= gain
                live -= fill[source] == 0
                moved = True
    order = np.argsort(owner, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)] if len(order) else []


def pack(parts: DataFrame, capacity: int = 4096, part: int = PART) -> DataFrame:
    """``parts`` (any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``parts`` is read twice, so hand over a written table.
    """
    from pyspark import TaskContext
    from pyspark.sql import types as T

    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*[f for f in parts.schema if f.name not in ("sequence_id", "offset")], *extra])
    parts = parts.select(*[f.name for f in schema.fields[:-2]])
    short = parts.where(F.col("length") < capacity)
    at = parts.columns.index("length")

    def numbered(table: pa.Table, bins: list[list[int]], first: int):
        lengths = table.column(at).to_numpy()
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        sizes = np.array([len(b) for b in bins], dtype=np.int64)
        ids = np.repeat(np.arange(len(bins), dtype=np.int64), sizes) + first
        before = np.cumsum(lengths[order]) - lengths[order]
        starts = np.repeat(before[np.cumsum(sizes) - sizes], sizes)
        got = table.take(pa.array(order))
        got = got.append_column("sequence_id", pa.array(ids, pa.int64()))
        return got.append_column("offset", pa.array(before - starts, pa.int64())).to_batches(max_chunksize=10_000)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column(at).to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        yield from numbered(table, bins, (2 * TaskContext.get().partitionId() + 1) << 31)

    def alone(batches):
        first = 2 * TaskContext.get().partitionId() << 31
        for batch in batches:
            if batch.num_rows:
                yield from numbered(pa.Table.from_batches([batch]), [[i] for i in range(batch.num_rows)], first)
                first += batch.num_rows

    n = max(1, -(-short.count() // part))
    packed = short.repartition(n).mapInArrow(run, schema)
    return packed.union(parts.where(F.col("length") >= capacity).mapInArrow(alone, schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Documents (doc_id, text) as placed pieces."""
    return pack(written(pieces(docs, tokenizer, length=capacity, end=end), "pieces"), capacity)
