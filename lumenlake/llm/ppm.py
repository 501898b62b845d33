"""Language-model scoring: prediction by partial matching over bytes, and a unigram base score.

Texts are lower-cased (A-Z). The model is a trie of byte contexts of up to ORDER bytes, counted over all
training texts: START bytes precede a text, an END symbol closes it. A symbol is coded in its longest context:
with c of the C occurrences there and q distinct followers it has probability c / (C + q); if unseen there,
an escape of q / (C + q) leads to the context that is a byte shorter, in which the symbols seen in the longer one
are excluded from counts and followers; below the empty context the rest of the 256 symbols are alike.
The score of a text is the sum of log10 of these probabilities: minus its code length.

Counts cover every training text and are gathered by a shuffle; nothing is left out of them. What is broadcast only saves
lookups: the probabilities of strings that make up at least 1 / NODES of all (NODES at most), worked out from the whole counts,
and likewise tokens that make up at least 1 / HEAD of all. Every other string or token of a text meets the whole counts in a shuffle.
Strings are dealt by the last SHORT bytes of their context, so that a task holds all longer contexts with that end;
counts of up to SHORT bytes, as many at any size of corpus, are broadcast. What a slice of texts asks of a bucket of strings
or tokens travels as one row.

Null texts count as empty and consist of their end only. Null ids are neither learned from nor held out.
Repeated rows and ids give one result row each; without training texts all symbols and tokens are unseen. Very long texts are read whole,
in slices of their own. Extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import cut, pieces, tidied

ORDER, SHORT, NODES, HEAD = 5, 3, 1 << 20, 1 << 17
START, END = 0xFE, 0xFF  # no byte of UTF-8
ABSENT = np.uint64((1 << 64) - 1)
#: The end's token; it holds a blank, as no word does.
END_TOKEN = b" end"
#: Distinct tokens or strings that a task holds before it hands them on.
HELD, HELD_STRINGS = 300_000, 1_000_000
SLICE_BYTES = 2_000_000
#: Strings or tokens that a task looks up in the whole counts at a time.
ASKED = 500_000
#: Buckets of strings and tokens for each partition of the shuffle.
BUCKETS = 8
COUNTED_STRING, COUNTED_TOKEN, TEXT, ASKED_STRINGS, ASKED_TOKENS = range(5)


def _raw(column: pa.Array) -> list[bytes]:
    """The texts' bytes, A-Z lower-cased."""
    return [t.lower() for t in pc.fill_null(column.cast(pa.binary()), b"").to_pylist()]


def _strings(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of all texts with the bytes before it, packed into 64 bits, the symbol lowest; the number of symbols of each text."""
    lead, tail = bytes([START]) * order, bytes([END])
    joined = np.frombuffer(b"".join(x for t in texts for x in (lead, t, tail)), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    packed = np.zeros(len(joined) - order, np.uint64)
    for back in range(order + 1):
        packed |= joined[order - back : len(joined) - back].astype(np.uint64) << np.uint64(8 * back)
    begins = np.cumsum([0, *(lengths[:-1] + order)])
    inside = np.ones(len(packed), bool)
    for back in range(1, order + 1):  # strings whose symbol is a START
        at = begins[1:] - back
        inside[at[at >= 0]] = False
    return packed[inside], lengths


COUNTS = "kind string, token binary, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts and string counts of a task's training texts."""
    schema = pa.schema([("kind", pa.string()), ("token", pa.binary()), ("n", pa.int64())])
    tokens: Counter[bytes] = Counter()
    grams, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def told(kind: str, keys: pa.Array, ns: list[int] | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(kind, len(keys)), keys, pa.array(ns, pa.int64())], schema=schema)

    def strings() -> pa.RecordBatch:
        size = ORDER + 1
        keys = np.ascontiguousarray(grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, -size:])
        offsets = np.arange(len(grams) + 1, dtype=np.int32) * size
        return told("string", pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(offsets), pa.py_buffer(keys)]), sums)

    for batch in batches:
        for lo, hi in pieces(batch.column(0), SLICE_BYTES):
            raw = _raw(batch.column(0).slice(lo, hi - lo))
            for t in raw:
                tokens.update(t.split())
            tokens[END_TOKEN] += len(raw)
            new, counts = np.unique(_strings(raw)[0], return_counts=True)
            both = np.concatenate([grams, new])
            grams, back = np.unique(both, return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, counts]), len(grams)).astype(np.int64)
            if len(tokens) >= HELD:
                yield told("token", pa.array(list(tokens), pa.binary()), list(tokens.values()))
                tokens.clear()
            if len(grams) >= HELD_STRINGS:
                yield strings()
                grams, sums = grams[:0], sums[:0]
    yield told("token", pa.array(list(tokens), pa.binary()), list(tokens.values()))
    yield strings()


def learn(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """kind (token or string), token, n: counts over all training texts, written to the shared folder."""
    texts = docs.where(train).select(docs[text_col])
    return cut(texts.mapInArrow(tidied(_count), COUNTS).groupBy("kind", "token").agg(F.sum("n").alias("n")), "counts")


class Logs:
    """Logarithms by packed string, by open addressing."""

    def __init__(self, strings: np.ndarray, logs: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(strings)).bit_length())
        self.keys = np.full(1 << self.bits, ABSENT, np.uint64)
        self.logs = np.zeros(1 << self.bits, np.float64)
        left, slot = np.arange(len(strings)), self._slot(strings)
        while len(left):
            free = self.keys[slot] == ABSENT
            self.keys[slot[free]] = strings[left[free]]  # of those that want one slot, one gets it
            done = self.keys[slot] == strings[left]
            self.logs[slot[done]] = logs[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, strings: np.ndarray) -> np.ndarray:
        return ((strings * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each string's logarithm, 0 for those that are absent; the places of these."""
        out = np.zeros(len(strings), np.float64)
        left, slot = np.arange(len(strings)), self._slot(strings)
        absent = []
        while len(left):
            found = self.keys[slot]
            hit = found == strings[left]
            out[left[hit]] = self.logs[slot[hit]]
            none = found == ABSENT
            absent.append(left[none])
            go = ~(hit | none)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out, np.sort(np.concatenate(absent)) if absent else left


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _suffixes(strings: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last size bytes of the strings, ascending, and their counts."""
    own, back = np.unique(strings & _mask(size), return_inverse=True)
    return own, np.bincount(back, counts, len(own)).astype(np.int64)


class Trie:
    """Log10 probabilities of symbols in contexts, from the strings of each length and their counts.

    Contexts of which it holds a string have to be whole, with all followers, and so has each of their suffixes.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """levels[k]: strings of k + 1 bytes, packed, ascending, and their counts; a string's suffixes are in the levels below."""
        self.levels = []
        for k, (strings, counts) in enumerate(levels):
            ctx, first = np.unique(strings >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first).astype(np.float64) if len(ctx) else np.zeros(0)
            kinds = np.diff(np.append(first, len(strings))).astype(np.float64)
            # What a context's followers count in the context that is a byte shorter, where they are excluded.
            excluded = np.zeros(len(ctx))
            if k and len(ctx):
                shorter, below = levels[k - 1]
                excluded = np.add.reduceat(below[np.searchsorted(shorter, strings & _mask(k))], first).astype(np.float64)
            self.levels.append((strings, counts.astype(np.float64), ctx, total, kinds, excluded))
        self.spare = 256 - len(levels[0][0])
        # Most symbols are found in the longest strings.
        strings, counts, ctx, total, kinds, _ = self.levels[-1]
        at = np.searchsorted(ctx, strings >> np.uint64(8))
        self.longest = Logs(strings, np.log10(counts / (total[at] + kinds[at])) if len(strings) else np.zeros(0))

    def score(self, strings: np.ndarray) -> np.ndarray:
        """Log10 probability of each string's last byte after the others."""
        out, rare = self.longest.find(strings)
        distinct, back = np.unique(strings[rare], return_inverse=True)
        out[rare] = self.escaping(distinct)[back]
        return out

    def escaping(self, strings: np.ndarray) -> np.ndarray:
        """The same from the longest context down, level by level."""
        out, open_ = np.zeros(len(strings)), np.arange(len(strings))
        lost = np.zeros(len(strings)), np.zeros(len(strings))  # counts and followers that are excluded
        for k in range(len(self.levels) - 1, -1, -1):
            own, counts, ctx, total, kinds, excluded = self.levels[k]
            if not len(own) or not len(open_):
                continue
            these = strings[open_] & _mask(k + 1)
            at = np.minimum(np.searchsorted(ctx, these >> np.uint64(8)), len(ctx) - 1)
            known = ctx[at] == these >> np.uint64(8)
            here, at, these = open_[known], at[known], these[known]
            c, q = total[at] - lost[0][here], kinds[at] - lost[1][here]
            place = np.minimum(np.searchsorted(own, these), len(own) - 1)
            seen = own[place] == these
            out[here[seen]] += np.log10(counts[place[seen]] / (c[seen] + q[seen]))
            escape = ~seen & (q > 0)
            out[here[escape]] += np.log10(q[escape] / (c[escape] + q[escape]))
            lost[0][here], lost[1][here] = excluded[at], kinds[at]
            open_ = np.setdiff1d(open_, here[seen], assume_unique=True)
        out[open_] -= np.log10(max(1, self.spare))
        return out


def build_trie(packed: list[tuple[bytes, bytes]]) -> Trie:
    """A trie of the levels' strings and counts, as bytes."""
    return Trie([(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for a, b in packed])


_heads: dict[int, Logs] = {}


def _packed(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(s.rjust(8, b"\0") for s in strings), ">u8").astype(np.uint64)


def _levels(counts: DataFrame, longest: int = ORDER + 1) -> list[tuple[bytes, bytes]]:
    """All strings of each length up to longest, ascending, and their counts."""
    by = counts.where("kind = 'string'").groupBy(F.substring("token", -longest, longest).alias("s")).agg(F.sum("n").alias("n")).toArrow()
    strings, n = _packed(by["s"].to_pylist()), by["n"].to_numpy()
    return [tuple(x.tobytes() for x in _suffixes(strings, n, k)) for k in range(1, longest + 1)]


def _head(counts: DataFrame) -> tuple[bytes, bytes]:
    """The strings of ORDER + 1 bytes that make up at least 1 / NODES of all, and their logarithms in the whole model."""
    strings = counts.where("kind = 'string'")
    total = strings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    context = Window.partitionBy(F.substring("token", 1, ORDER))
    log = F.log10(F.col("n") / (F.sum("n").over(context) + F.count(F.lit(1)).over(context)))
    kept = strings.select("token", "n", log.alias("log")).where(F.col("n") >= max(1, -(-total // NODES))).toArrow()
    return _packed(kept["token"].to_pylist()).tobytes(), kept["log"].to_numpy().astype(np.float64).tobytes()


def _bucket(context, buckets: int):  # noqa: ANN001, ANN202
    """The bucket of a packed context, a column or an array, by its last SHORT bytes."""
    mask = (1 << 8 * SHORT) - 1
    if isinstance(context, Column):
        return F.shiftright(context.bitwiseAND(F.lit(mask)) * F.lit(2_654_435_761), 16) % buckets
    return ((context & mask) * 2_654_435_761 >> 16) % buckets


def _whole(learned: dict[int, list[pa.RecordBatch]], short: list[tuple[bytes, bytes]]) -> tuple[Trie, dict[bytes, float]]:
    """From a task's counts, and the counts of up to SHORT bytes: the trie, and log10 of each token's count plus 1."""
    strings, tokens = (pa.Table.from_batches(learned[k], pa.schema([("__key", pa.binary()), ("__n", pa.int64())])) for k in (COUNTED_STRING, COUNTED_TOKEN))
    packed, n = _packed(strings["__key"].to_pylist()), strings["__n"].to_numpy()
    below = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for a, b in short]
    logs = np.log10(tokens["__n"].to_numpy() + 1.0).tolist()
    return Trie([*below, *[_suffixes(packed, n, k) for k in range(SHORT + 1, ORDER + 2)]]), dict(zip(tokens["__key"].to_pylist(), logs, strict=True))


def score_texts(docs: DataFrame, counts: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    tokens = counts.where("kind = 'token'").select("token", "n")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head_least = max(1, -(-total // HEAD))
    head = {bytes(r["token"]): math.log10(r["n"] + 1) for r in tokens.where(F.col("n") >= head_least).collect()}
    model = spark.sparkContext.broadcast((_head(counts), head))
    short = spark.sparkContext.broadcast(_levels(counts, SHORT))
    picked = docs.select(*keep, docs[text_col].alias("__text"))
    kept_fields = picked.select(*keep).schema.fields
    kinds = {"__row": T.LongType, "__tokens": T.LongType, "__known": T.LongType, "__log": T.DoubleType, "__score": T.DoubleType, "__kind": T.IntegerType, "__bucket": T.LongType, "__key": T.BinaryType, "__n": T.LongType, "__times": T.BinaryType, "__slice": T.LongType, "__of": T.BinaryType, "__sums": T.BinaryType}
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept_fields], *[T.StructField(n, t()) for n, t in kinds.items()]])
    arrow = to_arrow_schema(schema)
    told = T.StructType([*schema.fields[: len(keep) + 5], *schema.fields[-3:]])
    told_arrow = to_arrow_schema(told)
    scored = T.StructType([*kept_fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("__logs", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored_arrow = to_arrow_schema(scored)

    def filled(size: int, into: pa.Schema, **columns: object) -> pa.RecordBatch:
        """A batch with the columns given, all others null."""
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in into], schema=into)

    def asking(kind: int, row: int, bucket: np.ndarray, of: np.ndarray, times: np.ndarray, joined: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket: the texts that ask, counted from row on, how often, and what joined gives of the places."""
        order = np.argsort(bucket, kind="stable")
        if len(order):
            own, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            columns = {"__key": [joined(x) for x in parts], "__of": [of[x].astype(np.uint32).tobytes() for x in parts], "__times": [times[x].astype(np.uint32).tobytes() for x in parts]}
            yield filled(len(own), arrow, __row=np.full(len(own), row), __kind=np.full(len(own), kind), __bucket=own, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with what the heads give; and rows with each other string and token, by bucket."""
        packed, known = model.value
        if id(packed) not in _heads:  # a worker reads a broadcast once, and keeps it
            _heads.clear()
            _heads[id(packed)] = Logs(np.frombuffer(packed[0], np.uint64), np.frombuffer(packed[1], np.float64))
        heads = _heads[id(packed)]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in pieces(batch.column(len(keep)), SLICE_BYTES):
                raw = _raw(batch.column(len(keep)).slice(lo, hi - lo))
                symbols, lengths = _strings(raw)
                found, rare = heads.find(symbols)
                bits = np.add.reduceat(found, np.cumsum([0, *lengths[:-1]]))
                of, asked = np.repeat(np.arange(len(raw)), lengths)[rare], symbols[rare]
                order = np.lexsort((asked, of))
                of, asked = of[order], asked[order]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (asked[1:] != asked[:-1]))[: len(of)])
                times, of, asked = np.diff(np.append(first, len(of))), of[first], asked[first].astype(np.int64)
                yield from asking(ASKED_STRINGS, row, _bucket(asked >> 8, buckets), of, times, lambda x, asked=asked: asked[x].tobytes())
                at, sizes, certain, logs = [], [], [], []
                rare_at, rare_token, rare_n = [], [], []
                for i, t in enumerate(raw):
                    own = Counter(t.split())
                    own[END_TOKEN] = 1
                    seen, log = 0, 0.0
                    for token, n in own.items():
                        gain = known.get(token)
                        if gain is None:
                            rare_at.append(i)
                            rare_token.append(token)
                            rare_n.append(n)
                        else:
                            seen += n
                            log += n * gain
                    sizes.append(own.total())
                    certain.append(seen)
                    logs.append(log)
                at = np.arange(row, row + len(raw))
                bucket = np.fromiter(map(zlib.crc32, rare_token), np.int64, len(rare_token)) % buckets
                yield from asking(ASKED_TOKENS, row, bucket, np.array(rare_at, np.int64), np.array(rare_n, np.int64), lambda x, rare=rare_token: b"\n".join([rare[i] for i in x.tolist()]))
                row += len(raw)
                lead = dict(zip(keep, batch.slice(lo, hi - lo).columns[: len(keep)], strict=True))
                yield filled(len(at), arrow, **lead, __row=at, __tokens=sizes, __known=certain, __log=logs, __score=bits, __kind=np.full(len(at), TEXT), __bucket=at % buckets, __slice=np.full(len(at), at[0]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts' rows, and for what the others ask the answers of the whole counts, added up by text. Counts come first."""
        learned: dict[int, list[pa.RecordBatch]] = {COUNTED_STRING: [], COUNTED_TOKEN: []}
        asked: dict[int, list[tuple]] = {ASKED_STRINGS: [], ASKED_TOKENS: []}
        found, held = None, 0

        def answers() -> Iterator[pa.RecordBatch]:
            """For each slice of texts a row: which of them, and their sums (known tokens, their logarithms, logarithms of symbols)."""
            trie, tokens = found
            parts = []
            for kind, rows in asked.items():
                if not rows:
                    continue
                of = np.concatenate([at + np.frombuffer(of, np.uint32).astype(np.int64) for at, _, of, _ in rows])
                times = np.concatenate([np.frombuffer(n, np.uint32) for _, _, _, n in rows]).astype(np.float64)
                own, back = np.unique(of, return_inverse=True)
                sums = np.zeros((len(own), 3))
                if kind == ASKED_STRINGS:
                    logs = trie.score(np.concatenate([np.frombuffer(key, np.uint64) for _, key, _, _ in rows]))
                    sums[:, 2] = np.bincount(back, times * logs, len(own))
                else:
                    logs = np.array([tokens.get(x, 0.0) for _, key, _, _ in rows for x in key.split(b"\n")])
                    sums[:, 0] = np.bincount(back, times * (logs > 0), len(own))  # log10 of a count and 1
                    sums[:, 1] = np.bincount(back, times * logs, len(own))
                bases = np.unique([at for at, _, _, _ in rows])
                parts.append((bases, np.split(own, cuts := np.searchsorted(own, bases[1:])), np.split(sums, cuts)))
                rows.clear()
            for bases, owns, sums in parts:
                yield filled(len(bases), told_arrow, __slice=bases, __of=[x.tobytes() for x in owns], __sums=[x.tobytes() for x in sums])

        for batch in batches:
            kind = batch.column("__kind").to_numpy()
            for k, parts in learned.items():
                if (kind == k).any():
                    parts.append(batch.select(["__key", "__n"]).filter(pa.array(kind == k)))
            if (kind == TEXT).any():
                yield batch.select(told_arrow.names).filter(pa.array(kind == TEXT))
            asks = batch.select(["__kind", "__row", "__key", "__of", "__times"]).filter(pa.array(kind >= ASKED_STRINGS))
            for i in range(asks.num_rows):
                if found is None:
                    found = _whole(learned, short.value)
                    learned.clear()
                k, *ask = (c[i].as_py() for c in asks.columns)
                asked[k].append(ask)
                held += len(ask[-1]) // 4
                if held >= ASKED:
                    yield from answers()
                    held = 0
        if held:
            yield from answers()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a task's slices with all of their sums."""
        texts, ofs, sums = [], [], []
        for batch in batches:
            text = pc.is_valid(batch.column("__row"))
            texts.append(batch.filter(text))
            rest = batch.filter(pc.invert(text))
            ofs += [np.frombuffer(x, np.int64) for x in rest.column("__of").to_pylist()]
            sums += [np.frombuffer(x, np.float64).reshape(-1, 3) for x in rest.column("__sums").to_pylist()]
        if not texts:
            return
        whole = pa.Table.from_batches(texts).combine_chunks()
        rows = whole["__row"].to_numpy()
        total = np.column_stack([whole["__known"].to_numpy(), whole["__log"].to_numpy(), whole["__score"].to_numpy()]).astype(np.float64)
        if ofs:
            order = np.argsort(rows)
            at = order[np.searchsorted(rows, np.concatenate(ofs), sorter=order)]
            every = np.concatenate(sums)
            for i in range(3):
                total[:, i] += np.bincount(at, every[:, i], len(rows))
        columns = [*[whole[k] for k in keep], whole["__tokens"], pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1]), pa.array(total[:, 2])]
        yield from pa.Table.from_arrays(columns, schema=scored_arrow).to_batches(10_000)

    string = F.col("kind") == "string"
    context = F.conv(F.hex(F.substring("token", 1, ORDER)), 16, 10).cast("long")
    given = {
        "__kind": F.when(string, COUNTED_STRING).otherwise(COUNTED_TOKEN),
        "__bucket": F.when(string, _bucket(context, buckets)).otherwise(F.crc32("token") % buckets),
        "__key": F.col("token"),
        "__n": F.col("n"),
    }
    whole = counts.where(string | (F.col("n") < head_least)).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    rows = picked.mapInArrow(tidied(run), schema).unionByName(whole).repartition("__bucket").sortWithinPartitions("__kind").mapInArrow(tidied(solve), told)
    by_row = rows.repartition("__slice").mapInArrow(tidied(add), scored)
    base = F.col("__logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return by_row.select(*keep, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
