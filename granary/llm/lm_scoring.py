"""Language-model scores by a weighted backoff automaton.

The model is a trigram model. Unigrams are add-0.1 estimates that leave room for one unknown word; a bigram's probability is
(c(v w) + MU2 p(w)) / (c(v) + MU2), a trigram's (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3), with counts over all training
texts (Dirichlet smoothing, MacKay & Peto 1995) and MU2, MU3 fitted to them by leaving one out. The last two words are the
state. Each n-gram that training holds is an arc with its log-probability; without one, the failure arc leads to the shorter
state and adds that state's weight, log10(MU / (c + MU)). One left-to-right traversal of a text carries the state and adds up what it passes. No n-gram is
left out, whatever its count, and what a state needs is its own count alone.

All counts cover the whole corpus and stay distributed:

1. Documents are dealt by a digest to chunks of about CHUNK characters. A chunk lists its distinct n-grams once, as sorted
   hashes with their training counts, and sends each owner of a range of hashes its part, packed (differences of sorted
   hashes, as compressed byte planes, take about half the bytes of the hashes).
2. An owner adds up what chunks send for its range, and answers each chunk with the totals of the n-grams that it asked for.
3. A chunk is read again with its answers and its texts are walked.

A frequent n-gram thus sends one entry a chunk, and no task holds more than a chunk or a range. Words are told apart by
64-bit hashes, bigrams and trigrams by as many bits as leave one in 2**22 a namesake at the corpus's size.

Edge cases. Null, empty or blank text is the end token alone. A word that training lacks counts as the unknown word.
Null ids count as empty text in the fold. Repeated rows are scored one by one. An empty training set leaves every word
unknown. An empty table gives an empty result. Other input columns are not read. Ids may have any type.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .tokens import tidy

ADD = 0.1
CHUNK, RANGE = 10_000_000, 5_000_000
END = b"\n"  # no word holds white space
SPARE_BITS, KNOWN = 22, 400_000
ORDERS = (1, 2, 3)


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Hashes:
    """Hashes of words, with a bounded table of those met before."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of texts one after another, each between two ends; and each text's length, ends included."""
        import xxhash

        digest, parts, sizes = xxhash.xxh64_intdigest, [], []
        for text in texts:
            seq = [END, *tokens(text)]
            known = self.known
            if len(known) > KNOWN:
                known.clear()
            for w in set(seq).difference(known):
                known[w] = digest(w, 42)
            parts.append(np.fromiter(map(known.__getitem__, seq), np.uint64, len(seq)))
            sizes.append(len(seq))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, dtype=np.int64)


def _grams(h: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the keys of n-grams that end at a token, and the tokens' positions: none spans two texts. The end before
    a text is no token, but a word's first context."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    two = _mixed(h[:-1], h[1:])
    at1 = np.flatnonzero(np.concatenate([[False], text[1:] == text[:-1]])) if len(h) else np.zeros(0, np.int64)
    at3 = 2 + np.flatnonzero(text[2:] == text[:-2])
    three, drop = _mixed(two[at3 - 2], h[at3]), np.uint64(64 - bits)
    return [h[at1], two[at1 - 1] >> drop, three >> drop], [at1, at1, at3]


def _bytes_of(counts: np.ndarray) -> bytes:
    """Counts of 255 and more follow the others."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _counts_of(raw: np.ndarray, n: int) -> np.ndarray:
    counts = raw[:n].astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:].tobytes(), "<i8")
    return counts


def _pack(n: int, raw: bytes) -> bytes:
    import pyarrow as pa

    return n.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[int, np.ndarray]:
    import pyarrow as pa

    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    return n, np.frombuffer(pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def pack_entries(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences of keys by byte planes, compressed."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return _pack(len(keys), planes.tobytes() + _bytes_of(counts))


def unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = _unpack(blob)
    keys = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(keys, dtype=np.uint64), _counts_of(raw[8 * n :], n)


class Plan:
    """How a corpus is cut: chunks of documents, ranges of hashes (a power of two), bits of n-gram keys.

    Chunks and ranges have a fixed size until a chunk's part for a range would get as small as its overhead; from there on
    both grow as the root of the corpus, to some 200 MB at 100 TB.
    """

    def __init__(self, df: DataFrame, text_col: str, chunk: int = CHUNK, span: int = RANGE):
        size = df.agg(F.coalesce(F.sum(F.char_length(F.col(f"`{text_col}`"))), F.lit(0)).cast("long")).first()[0]
        least, few = math.isqrt(200 * size), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.chunks = max(1, -(-size // max(chunk, least)), min(few, size // 500_000))
        self.range_bits = math.ceil(math.log2(max(1, -(-size // max(span, least)))))
        self.bits = min(64, math.ceil(math.log2(max(2, size))) + SPARE_BITS)

    def owner(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The range of each key; sorted keys have rising ranges."""
        if not self.range_bits:
            return np.zeros(len(keys), np.int64)
        return (keys >> np.uint64((64 if order == 1 else self.bits) - self.range_bits)).astype(np.int64)


def _dealt(df: DataFrame, plan: Plan, id_col: str, text_col: str, train: Column) -> DataFrame:
    """(chunk, doc, train, text): a chunk is a partition."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    chunk = F.pmod(F.xxhash64(ident.cast("string"), text), F.lit(plan.chunks)).cast("int")
    return df.select(chunk.alias("chunk"), ident.alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))


def _asks(plan: Plan):
    """The texts of a chunk to (owner, chunk, gram, data): its distinct n-grams with their training counts, by owner."""

    def run(batches):
        import pyarrow as pa

        chunk, texts, trains = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                chunk = part.column("chunk")[0].as_py()
                texts += part.column("text").to_pylist()
                trains += part.column("train").to_pylist()
        if not texts:
            return
        h, sizes = Hashes()(texts)
        del texts
        known = np.repeat(np.array(trains, dtype=np.float64), sizes)
        for order, key, at in zip(ORDERS, *_grams(h, sizes, plan.bits)):
            keys, where = np.unique(key, return_inverse=True)
            counts = np.bincount(where, known[at], minlength=len(keys)).astype(np.int64)
            owner = plan.owner(keys, order)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            data = [pack_entries(keys[a:b], counts[a:b]) for a, b in zip(begin, [*begin[1:], len(keys)])]
            n = len(begin)
            cols = [pa.array(owner[begin], pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["owner", "chunk", "gram", "data"])
        tidy()

    return run


def _answers(batches):
    """What chunks ask an owner to (chunk, gram, owner, data, total, types): all chunks' counts together, to each as it asked."""
    import pyarrow as pa

    asked: dict[int, list] = {o: [] for o in ORDERS}
    owner = 0
    for batch in batches:
        for o, chunk, order, data in zip(*[batch.column(c).to_pylist() for c in ("owner", "chunk", "gram", "data")]):
            owner = o
            asked[order].append((chunk, data))
    names = ["chunk", "gram", "owner", "data", "total", "types"]
    for order, got in asked.items():
        if not got:
            continue
        parts = [unpack_entries(data) for _, data in got]
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = np.bincount(where, np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        data = [_pack(int(b - a), _bytes_of(sums[where[a:b]])) for a, b in zip([0, *ends[:-1]], ends)]
        n, first = len(got), order == 1
        total, types = [0] * n, [0] * n
        if first:
            total[0], types[0] = int(sums.sum()), int((sums > 0).sum())
        cols = [pa.array([c for c, _ in got], pa.int32()), pa.array([order] * n, pa.int32()), pa.array([owner] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(total, pa.int64()), pa.array(types, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names)
        # how counts are spread: for each number of binary digits, their sum and their number
        digits = np.frexp(sums[sums > 0].astype(np.float64))[1]
        there = np.unique(digits)
        k = len(there)
        cols = [pa.array(there, pa.int32()), pa.array([-order] * k, pa.int32()), pa.array([owner] * k, pa.int32()), pa.nulls(k, pa.binary())]
        cols += [pa.array([int(sums[sums > 0][digits == d].sum()) for d in there], pa.int64()), pa.array([int((digits == d).sum()) for d in there], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names)
    tidy()


def fitted(contexts: list[tuple[int, int]], singles: int) -> float:
    """The weight of the shorter state at which training foresees its own singletons.

    Leave one token out: it is then an unseen n-gram if it was its only instance, and its context of count c foresees that
    with mu / (c - 1 + mu). The sum of that over all tokens rises with mu; it is made equal to the singletons. contexts:
    (sum of counts, number) of contexts of about one count.
    """
    foreseen = lambda mu: sum(total * mu / (total / n - 1 + mu) for total, n in contexts)
    low, high = 1e-3, 1e9
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if foreseen(middle) < singles else (low, middle)
    return high


class Automaton:
    """The part of the model that a chunk's texts can reach: states, arcs and failure arcs, as arrays.

    numbers: for each order the number of the n-gram that ends at each position (-1: none); counts: by number, in training.
    States are the words and bigrams that training holds, and the root; a state has its n-gram's number. An arc has the
    number of the n-gram that it completes, and is there if training holds that. It leads to the state of the last two
    words, or of the last one, or the root, whichever is the longest that there is. A failure arc leads to the state of the
    same words without the first.
    """

    def __init__(self, numbers: list[np.ndarray], counts: list[np.ndarray], total: int, types: int, mu: tuple[float, float]):
        self.numbers, self.held = numbers, [c > 0 for c in counts]
        p = (counts[0] + ADD) / (total + ADD * (types + 1))
        self.arcs, self.fail = [np.log10(p)], []
        for order in (1, 2):
            here, before = numbers[order], numbers[order - 1]
            at = np.full(len(counts[order]), -1, dtype=np.int64)  # a position of each n-gram
            where = np.flatnonzero(here >= 0)
            at[here[where]] = where
            context, m = counts[order - 1][before[at - 1]], mu[order - 1]
            p = (counts[order] + m * p[before[at]]) / (context + m)
            self.arcs.append(np.log10(p))
            self.fail.append(np.log10(m / (counts[order - 1] + m)))

    def walk(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log-probability of each text, from the end before it on, all texts a word further at a time. sizes: positions of a
        text, that end included. The state is carried: how many words it has, and its numbers as a word and as a bigram."""
        score, order = np.zeros(len(sizes)), np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        n1, n2, n3 = self.numbers
        word = n1[starts]
        pair, deep = np.full(len(sizes), -1), self.held[0][word].astype(np.int8)
        live = len(sizes)
        for step in range(1, int(sizes.max(initial=0))):
            while live and sizes[live - 1] <= step:
                live -= 1
            at = starts[:live] + step
            word, pair, deep = word[:live], pair[:live], deep[:live]
            i, j = n1[at], n2[at]
            gain = np.zeros(live)
            two = np.flatnonzero(deep == 2)
            k = n3[at[two]]
            found = self.held[2][k]
            gain[two[found]] = self.arcs[2][k[found]]
            fell = two[~found]
            gain[fell] = self.fail[1][pair[fell]]
            one = np.concatenate([np.flatnonzero(deep == 1), fell])
            found = self.held[1][j[one]]
            gain[one[found]] += self.arcs[1][j[one[found]]]
            fell = one[~found]
            gain[fell] += self.fail[0][word[fell]]
            root = np.concatenate([np.flatnonzero(deep == 0), fell])
            gain[root] += self.arcs[0][i[root]]
            score[order[:live]] += gain
            word, pair, deep = i, j, np.where(self.held[1][j], 2, self.held[0][i]).astype(np.int8)
        return score


def _walks(plan: Plan, total: int, types: int, ids, mu: tuple[float, float]):
    """The texts and answers of a chunk to (doc, train, n_tokens, n_known, base_score, score)."""

    def run(batches):
        import pyarrow as pa

        docs, trains, texts, answers = [], [], [], {o: [] for o in ORDERS}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for gram, owner, data, doc, train, text in zip(*[part.column(c).to_pylist() for c in ("gram", "owner", "data", "doc", "train", "text")]):
                    if gram:
                        answers[gram].append((owner, data))
                    else:
                        docs.append(doc)
                        trains.append(train)
                        texts.append(text)
        if not docs:
            return
        h, sizes = Hashes()(texts)
        del texts
        counts, numbers = [], []
        for order, key, at in zip(ORDERS, *_grams(h, sizes, plan.bits)):
            keys, where = np.unique(key, return_inverse=True)
            got = [_counts_of(raw, n) for _, data in sorted(answers.pop(order)) for n, raw in [_unpack(data)]]
            got = np.concatenate([np.zeros(0, np.int64), *got])
            if len(got) != len(keys):
                raise RuntimeError("a chunk of texts has changed between two reads")
            counts.append(got.astype(np.float64))
            numbers.append(np.full(len(h), -1, dtype=np.int64))
            numbers[-1][at] = where
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        numbers[0][starts] = numbers[0][ends]  # an end is the context of a text's first word
        automaton = Automaton(numbers, counts, total, types, mu)
        text, token = np.repeat(np.arange(len(sizes)), sizes), np.ones(len(h), dtype=bool)
        token[starts] = False
        text, word = text[token], numbers[0][token]
        sums = lambda weight: np.bincount(text, weight, minlength=len(docs))
        cols = [pa.array(docs, ids), pa.array(trains, pa.bool_()), pa.array(sizes - 1), pa.array(sums(automaton.held[0][word]).astype(np.int64))]
        cols += [pa.array(sums(automaton.arcs[0][word])), pa.array(automaton.walk(starts, sizes))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])
        tidy()

    return run


def score(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: tuple[float, float] | None = None,
    chunk: int = CHUNK, span: int = RANGE,
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    train: which rows the model learns from. mu: weights of the shorter states, in tokens, fitted to the training rows unless
    given. chunk, span: characters of a chunk of texts and of a range's share, which bound what a task holds; results do not
    depend on them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    plan, kind = Plan(df, text_col, chunk, span), df.select(F.col(f"`{id_col}`")).schema[0].dataType
    docs = _dealt(df, plan, id_col, text_col, train)
    asks = docs.repartitionById(plan.chunks, "chunk").mapInArrow(_asks(plan), "owner int, chunk int, gram int, data binary")
    answers = asks.repartitionById(1 << plan.range_bits, "owner").mapInArrow(_answers, "chunk int, gram int, owner int, data binary, total long, types long")
    answers = materialize(answers, "lm-answers")
    zero = F.lit(0).cast("long")
    total, types = answers.where("gram > 0").agg(F.coalesce(F.sum("total"), zero), F.coalesce(F.sum("types"), zero)).first()
    if mu is None:  # at most 64 rows an order
        held = answers.where("gram < 0").groupBy((-F.col("gram")).alias("gram"), "chunk").agg(F.sum("total").alias("total"), F.sum("types").alias("n")).collect()
        of = lambda order: sorted((r.total, r.n) for r in held if r.gram == order)
        mu = tuple(fitted(of(order), sum(r.n for r in held if r.gram == order + 1 and r.chunk == 1)) for order in (1, 2))
    none = lambda kind: F.lit(None).cast(kind)
    both = docs.select("chunk", F.lit(0).alias("gram"), F.lit(0).alias("owner"), none("binary").alias("data"), "doc", "train", "text").unionByName(
        answers.where("gram > 0").select("chunk", "gram", "owner", "data", none(kind).alias("doc"), F.lit(False).alias("train"), none("string").alias("text"))
    )
    schema = f"doc_id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double"
    out = both.repartitionById(plan.chunks, "chunk").mapInArrow(_walks(plan, total, types, to_arrow_type(kind), mu), schema)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
