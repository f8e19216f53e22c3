"""Language identification by Bayesian evidence fusion.

The posterior of each language is the product of four pieces of evidence: the text's likelihood (hashed byte trigrams, counted
over all documents by declared language), the declared language (how often texts of a language carry that declaration), the
address suffix (how often texts of a language lie under it), and a prior for the host, smoothed towards that of its domain and
that towards the corpus. All of them come from grouped aggregations over every document. "und" is one more outcome, with the same
likelihood for every trigram.

Defined cases: a null or letterless text has no text evidence and is judged by the rest. A null declaration, address or host is no
evidence, and a blank or "und" declaration names no language. Every language whose declared texts have ``least_trigrams`` trigrams
together is learned, whatever its share of the corpus. A language with less text can't be judged by a model of its own, nor fairly by
those of others: its documents keep their declaration, and have a null posterior. With no learned language documents without a
declaration are "und". Ties go to the language that sorts first. Repeated rows are
judged one by one and count each. Only the columns named are read, so extra columns can't clash; ``keep_certain`` returns all columns
of its input, with lang set to the language found. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, byte_chunks, cut, fold_case, join_checked

BITS = 14
UND = "und"
#: Weight of the text's log-likelihood: its trigrams overlap, so they are no independent evidence.
TEMPER = 0.25
#: Prior share of "und".
UND_PRIOR = 1e-3
#: Documents that the prior of the level above weighs as much as.
SMOOTH = 20.0
#: Trigrams that a language's model is counted from at least.
LEAST_TRIGRAMS = 4096
#: Languages whose counts a task gathers to its end; those of others it passes on chunk by chunk.
_SLOTS = 64


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that begins at each byte but the last two, and whether it counts (has a letter in the middle and lies in one text)."""
    raw = fold_case(raw)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 0x80)
    x = np.where(letter, raw, np.uint8(32)).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    h = ((x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    good = letter[1:-1].copy()
    for back in (1, 2):
        over = offsets[1:-1] - back
        good[over[(over >= 0) & (over < len(good))]] = False
    return h, good


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts n of the trigrams in each bucket by declared language d."""
    slot: dict[str, int] = {}
    total = np.zeros(_SLOTS << BITS, np.int64)

    def rows(names: list[str], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(key >> BITS)), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n)], names=["d", "bucket", "n"])

    for batch in batches:
        for part, raw, offsets in byte_chunks(batch, "text"):
            said = part.column(1).to_pylist()
            others: dict[str, int] = {}
            for x in dict.fromkeys(said):
                if x is not None and x not in slot:
                    if len(slot) < _SLOTS:
                        slot[x] = len(slot)
                    else:
                        others[x] = _SLOTS + len(others)
            code = slot | others
            h, good = trigrams(raw, offsets)
            doc = np.repeat(np.array([code.get(x, -1) for x in said], np.int64), np.diff(offsets))[: len(h)]
            good &= doc >= 0
            key = (doc[good] << BITS) + h[good]
            if others:
                rest, n = np.unique(key[key >= _SLOTS << BITS], return_counts=True)
                yield rows(list(others), rest - (_SLOTS << BITS), n)
                key = key[key < _SLOTS << BITS]
            total[: len(slot) << BITS] += np.bincount(key, minlength=len(slot) << BITS)
    some = np.flatnonzero(total)
    yield rows(list(slot), some, total[some])


def _scores(sent):
    """Adds ll: the log-likelihood of the text under each column of table, less that under "und"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        width = table.shape[1]
        for batch in batches:
            for part, raw, offsets in byte_chunks(batch, "__text"):
                h, good = trigrams(raw, offsets)
                at = np.minimum(offsets, len(h))
                out = np.zeros((len(offsets) - 1, width + 1))
                h = np.where(good, h, np.uint32(table.shape[0] - 1))  # the last row has zeros
                for l in range(width):
                    total = np.concatenate(([0], np.cumsum(table[h, l], dtype=np.float64)))
                    out[:, l] = total[at[1:]] - total[at[:-1]]
                keep = [i for i, name in enumerate(part.schema.names) if name != "__text"]
                ll = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width + 1, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), ll], names=[*(part.schema.names[i] for i in keep), "__ll"])

    return run


def _host(address: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class Model:
    """Everything counted from a corpus; ``evidence`` and ``posterior`` apply it."""

    def __init__(self, docs: DataFrame, text: str = "text", declared: str = "lang", address: str | None = None, host: str | None = "source", least_trigrams: int = LEAST_TRIGRAMS):
        self.text, self.declared, self.address, self.host = text, declared, address, host
        pairs = docs.select(F.col(text).alias("text"), F.col(declared).alias("d")).where(_names_language("d")).mapInArrow(_counts, "d string, bucket int, n long")
        pairs = cut(pairs.groupBy("d", "bucket").agg(F.sum("n").alias("n")))
        learned = pairs.groupBy("d").agg(F.sum("n").alias("all")).where(F.col("all") >= least_trigrams).select("d").collect()
        self.langs = sorted(r[0] for r in learned)
        self.names = [*self.langs, UND]
        counts = np.zeros((1 << BITS, len(self.langs)), order="F")
        if self.langs:
            numbers = docs.sparkSession.createDataFrame(list(enumerate(self.langs)), "l int, d string")
            r = join_checked(pairs, numbers, ["d"], "inner").select("l", "bucket", "n").toPandas()  # languages x buckets
            counts[r["bucket"], r["l"]] = r["n"]
        table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << BITS))) + np.log(1 << BITS)
        self.table = np.asfortranarray(np.vstack([table, np.zeros((1, len(self.langs)))]), np.float32)
        self.sent = docs.sparkSession.sparkContext.broadcast(self.table)
        seen = cut(self._scored(docs, []).select("__declared", "__suffix", "__domain", "__host", self._best().alias("best")))
        self.k = len(self.names)
        best = {r["best"]: r["count"] for r in seen.groupBy("best").count().collect()}
        total = sum(best.values())
        all_n = np.array([float(best.get(i, 0)) for i in range(self.k)]) + 1
        all_n[-1] = UND_PRIOR / (1 - UND_PRIOR) * max(all_n[:-1].sum(), 1.0)
        self.prior = (all_n / all_n.sum()).tolist()
        last = self.k - 1  # "und"
        array = lambda values: f"array({', '.join(f'{float(x)!r}D' for x in values)})"

        def counted(*by: str) -> DataFrame:
            """by, n (a map from each language's number to the rows that look like it), known (rows that look like any but "und") and v (rows)."""
            each = seen.where(F.col(by[0]).isNotNull()).groupBy(*by, "best").agg(F.count("*").cast("double").alias("c"))
            known = F.sum(F.expr(f"CASE WHEN best BETWEEN 0 AND {last - 1} THEN c ELSE 0D END"))
            return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("n"), known.alias("known"), F.sum("c").alias("v"))

        # Evidence of a value v: P(v | language), each language's values smoothed by the corpus' share of v.
        self.tables = {}
        for name in ("__declared", "__suffix"):
            logs = F.expr(f"transform({array(all_n)}, (a, i) -> CASE WHEN i < {last} THEN ln((coalesce(n[i], 0D) + {SMOOTH}D * v / {max(total, 1)}D) / (a + {SMOOTH}D)) ELSE ln(v / {max(total, 1)}D) END)")
            self.tables[name] = cut(counted(name).select(name, logs.alias(f"{name}_e")))
        share = lambda above: F.expr(f"transform({above}, (a, i) -> CASE WHEN i < {last} THEN (coalesce(n[i], 0D) + {SMOOTH}D * a) / (known + {SMOOTH}D) ELSE {self.prior[-1]!r}D END)")
        domains = counted("__domain").select("__domain", share(array(self.prior)).alias("above"))
        hosts = counted("__host", "__domain").join(domains, "__domain", "left")
        logs = F.transform(share(f"coalesce(above, {array(self.prior)})"), lambda p: F.log(p))
        self.tables["__host"] = cut(hosts.select("__host", logs.alias("__host_e")))

    def _scored(self, docs: DataFrame, carry: list[Column]) -> DataFrame:
        null = F.lit(None).cast("string")
        host = F.col(f"`{self.host}`").cast("string") if self.host else _host(F.col(self.address)) if self.address else null
        named = _host(F.col(self.address)) if self.address else null
        taken = docs.select(
            *carry,
            F.col(self.declared).alias("__declared"),
            F.nullif(F.regexp_extract(named, r"\.([a-z]+)$", 1), F.lit("")).alias("__suffix"),
            F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host).alias("__domain"),
            host.alias("__host"),
            F.col(self.text).alias("__text"),
        )
        schema = T.StructType([f for f in taken.schema.fields if f.name != "__text"] + [T.StructField("__ll", T.ArrayType(T.DoubleType()))])
        return taken.mapInArrow(_scores(self.sent), schema)

    @staticmethod
    def _best() -> Column:
        return F.expr("CASE WHEN array_max(__ll) = 0 THEN -1 ELSE array_position(__ll, array_max(__ll)) - 1 END")

    def judged(self, docs: DataFrame, carry: list[Column]) -> DataFrame:
        """The carried columns, ``__found`` and ``__posterior`` (null where the declaration stands for want of a model) of each row; one narrow pass unless a table of hosts is too large to broadcast."""
        rows = self._scored(docs, carry)
        for name in ("__declared", "__suffix", "__host"):
            rows = join_checked(rows, self.tables[name], [name], "left", BROADCAST_ROWS * 8 // max(8, self.k))
        nothing = ", ".join("0D" for _ in range(self.k))
        prior = ", ".join(f"{float(np.log(p))}D" for p in self.prior)
        term = lambda name, other: f"coalesce({name}_e, array({other}))"
        add = lambda a, b: f"zip_with({a}, {b}, (x, y) -> x + y)"
        total = add(add(f"transform(__ll, x -> x * {TEMPER}D)", term("__host", prior)), add(term("__declared", nothing), term("__suffix", nothing)))
        rows = rows.withColumn("__log", F.expr(total)).withColumn("__top", F.expr("array_max(__log)"))
        found = F.element_at(F.array(*[F.lit(n) for n in self.names]), F.expr("CAST(array_position(__log, __top) AS int)"))
        model = ~_names_language("__declared") | F.col("__declared").isin(self.langs)
        found = F.when(model, found).otherwise(F.col("__declared"))
        return rows.withColumn("__found", found).withColumn("__posterior", F.when(model, F.expr("1 / aggregate(__log, 0D, (a, x) -> a + exp(x - __top))")))


def _names_language(declared: str) -> Column:
    return F.coalesce((F.trim(declared) != "") & (F.col(declared) != UND), F.lit(False))


def _certain(least: float) -> Column:
    return (F.col("__found") != UND) & F.coalesce(F.col("__posterior") >= least, F.lit(True))


def identify(docs: DataFrame, key: str = "doc_id", certain: float = 0.9, **columns) -> DataFrame:
    """key, declared, language, posterior and keep (a language, with at least that posterior, or by its declaration) of each row."""
    rows = Model(docs, **columns).judged(docs, [F.col(key).alias(key)])
    return rows.select(key, F.col("__declared").alias("declared"), F.col("__found").alias("language"), F.col("__posterior").alias("posterior"), _certain(certain).alias("keep"))


def keep_certain(docs: DataFrame, certain: float = 0.9, **columns) -> DataFrame:
    """The rows whose language is certain or stands by its declaration, with lang set to it."""
    names = docs.columns
    rows = Model(docs, **columns).judged(docs, [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)])
    declared = columns.get("declared", "lang")
    return rows.where(_certain(certain)).select(*[(F.col("__found") if c == declared else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names)])
