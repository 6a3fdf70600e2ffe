"""URL filter: rules first, then the ratio of two character language models.

Rules decide for their hosts. Their verdicts also label URLs: a smoothed variable-order
Markov model is counted from the allowed ones and one from the blocked ones, all of them but
a held-out fifth. A URL that no rule fits gets the difference of its log-likelihoods,
divided by its length, and is allowed from a threshold up. The threshold is calibrated on the
held-out fifth: of 0.01-wide steps, the middle of those with the best sum of both rates of
right verdicts.

Nothing is hashed together: a gram, four symbols and the one after them, is a number of 45
bits. The grams of the distinct URLs and how often each model saw them are a table that grows
with the corpus; counts of shorter contexts are sums over it. The log ratio of every distinct
gram comes from joins of that table with the sums, where a key has at most ``258 ** 2`` grams,
and a URL's score is the sum over its grams. Grams that make up a ``HOT``-th of all positions,
so no more than ``HOT`` of them, are summed where the URLs are read; the others by a join.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no
rule and scores 0; repeated rows are counted and judged each; without labels of both kinds
every score and the threshold are 0, which allows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.staging import staged
from wakeline.llm.words import Chunk, chunks

ORDERS = 5
HOT = 4096
FOLDS = 5
_BITS = 9
_STEP, _STEPS = 0.01, 1000


class Rule(NamedTuple):
    """Verdict for a host, its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and the path, A-Z lower-cased; the path."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _positions(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every byte of every URL and its end: URL number, symbol, and the 0 to ``ORDERS - 1``
    symbols before it (257 before the first, 256 at the end) as one number, nearest lowest."""
    size = np.diff(chunk.offsets)
    pad = ORDERS - 1
    width = size + pad + 1
    begin = np.cumsum(width) - width
    symbol = np.full(int(width.sum()), 257, np.int64)
    place = np.repeat(begin + pad, size) + np.arange(len(chunk.data)) - np.repeat(chunk.offsets[:-1], size)
    symbol[place] = chunk.data
    symbol[begin + width - 1] = 256
    real = np.sort(np.concatenate((place, begin + width - 1)))
    owner = np.repeat(np.arange(chunk.texts), size + 1)
    contexts = [np.zeros(len(real), np.int64)]
    for back in range(1, ORDERS):
        contexts.append(contexts[-1] | symbol[real - back] << _BITS * (back - 1))
    return owner, symbol[real], contexts


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    owner, symbol, contexts = _positions(chunk)
    return owner, contexts[-1] << _BITS | symbol


def _held_out(urls: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((u.as_py() or "").encode("utf-8", "surrogatepass")) % FOLDS == 0 for u in urls], bool)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct URLs to their grams: places, and times each model was shown them."""
    for batch in batches:
        train = ~_held_out(batch.column("url"))
        times = batch.column("times").to_numpy()
        shown = [
            times * (train & pc.fill_null(pc.equal(batch.column("allowed"), a), False).to_numpy(zero_copy_only=False))
            for a in (False, True)
        ]
        for chunk in chunks(batch.column("url")):
            owner, gram = _grams(chunk)
            key, at = np.unique(gram, return_inverse=True)
            sums = [np.zeros(len(key), np.int64) for _ in range(3)]
            for total, each in zip(sums, (np.ones_like(times), *shown)):
                np.add.at(total, at, each[chunk.first + owner])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sums)], names=["gram", "seen", "blocked", "allowed"])


def gram_counts(urls: DataFrame) -> DataFrame:
    """``gram, seen, blocked, allowed`` of distinct ``url`` with ``allowed`` (or null) and ``times``."""
    rows = urls.select("url", "allowed", "times").mapInArrow(_count, "gram bigint, seen bigint, blocked bigint, allowed bigint")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("seen", "blocked", "allowed")])


def gram_ratios(counts: DataFrame) -> DataFrame:
    """``gram, seen, ratio``: log of the allowed model's probability over the blocked one's.

    Orders are blended from the shortest to the longest context, each by how many kinds of
    symbols followed it (Witten-Bell).
    """
    table = counts
    for m in (0, 1):
        table = table.withColumn(f"p{m}", F.lit(1 / 257))
    shown = counts.where("blocked + allowed > 0")
    for k in range(ORDERS):
        pair = F.col("gram").bitwiseAND(F.lit((1 << _BITS * (k + 1)) - 1))
        pairs = shown.groupBy(pair.alias("_pair")).agg(F.sum("blocked").alias("n0"), F.sum("allowed").alias("n1"))
        contexts = pairs.groupBy(F.call_function("shiftright", "_pair", F.lit(_BITS)).alias("_context")).agg(
            *[F.sum(f"n{m}").alias(f"total{m}") for m in (0, 1)],
            *[F.count(F.when(F.col(f"n{m}") > 0, 1)).alias(f"kinds{m}") for m in (0, 1)],
        )
        # Of up to two symbols there are no more than 258 ** 2; longer ones are joined as tables.
        if k + 1 <= 2:
            pairs = F.broadcast(pairs)
        if k <= 2:
            contexts = F.broadcast(contexts)
        table = table.join(pairs, pair == F.col("_pair"), "left")
        table = table.join(contexts, F.call_function("shiftright", pair, F.lit(_BITS)) == F.col("_context"), "left")
        for m in (0, 1):
            n, total, kinds, p = F.coalesce(f"n{m}", F.lit(0)), F.col(f"total{m}"), F.col(f"kinds{m}"), F.col(f"p{m}")
            table = table.withColumn(f"p{m}", F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p))
        table = table.select("gram", "seen", "p0", "p1")
    return table.select("gram", "seen", (F.log("p1") - F.log("p0")).alias("ratio"))


class Models:
    """Symbols that the models were shown, and log ratios of the grams held in memory (ascending)."""

    def __init__(self, total: Sequence[int] = (0, 0), grams: np.ndarray | None = None, ratios: np.ndarray | None = None):
        self.total = np.array(total, np.int64)
        self.grams = np.zeros(0, np.int64) if grams is None else grams
        self.ratios = np.zeros(0) if ratios is None else ratios

    @property
    def trained(self) -> bool:
        return bool((self.total > 0).all())

    def held(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is in memory, and its place there."""
        at = np.searchsorted(self.grams, gram)
        if not len(self.grams):
            return np.zeros(len(gram), bool), at
        at = np.minimum(at, len(self.grams) - 1)
        return self.grams[at] == gram, at

    def scores(self, chunk: Chunk) -> np.ndarray:
        """What the grams in memory add to the mean log ratio per symbol of each URL."""
        if not self.trained:
            return np.zeros(chunk.texts)
        owner, gram = _grams(chunk)
        here, at = self.held(gram)
        sums = np.bincount(owner[here], weights=self.ratios[at[here]], minlength=chunk.texts)
        size = np.diff(chunk.offsets)
        return np.where(size > 0, sums / (size + 1), 0.0)

    def others(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """URL number, gram and share of the URL's symbols, for grams that are not in memory."""
        owner, gram = _grams(chunk)
        size = np.diff(chunk.offsets)
        use = ~self.held(gram)[0] & (size[owner] > 0)
        owner, gram = owner[use], gram[use]
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(owner)))
        return owner[first], gram[first], n / (size[owner[first]] + 1)


def _score(models) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [models.value.scores(c) for c in chunks(batch.column("url"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(_held_out(batch.column("url"))), pa.array(score, pa.float64())],
                names=[*names, "held_out", "score"],
            )

    return run


def _others(models) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column("u").to_numpy()
            for chunk in chunks(batch.column("url")):
                owner, gram, share = models.value.others(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u[chunk.first + owner], gram, share)], names=["u", "gram", "share"])

    return run


def score_urls(urls: DataFrame, hot: int = HOT) -> DataFrame:
    """``u, url, allowed, times, held_out, score`` of distinct URLs numbered ``u``; written once."""
    context = urls.sparkSession.sparkContext
    counts = staged(gram_counts(urls))
    sums = counts.agg(F.sum("seen"), F.sum("blocked"), F.sum("allowed")).first()
    seen, *total = [x or 0 for x in sums]
    if not Models(total).trained:
        return staged(urls.mapInArrow(_score(context.broadcast(Models())), _SCORED))
    ratios = staged(gram_ratios(counts))
    often = F.col("seen") * hot >= seen
    # Each makes up a hot-th of the positions or more: at most ``hot`` rows.
    held = ratios.where(often).select("gram", "ratio").toArrow().sort_by("gram")
    models = context.broadcast(Models(total, held["gram"].to_numpy(), held["ratio"].to_numpy()))
    scored = urls.mapInArrow(_score(models), _SCORED)
    rest = urls.select("u", "url").mapInArrow(_others(models), "u bigint, gram bigint, share double")
    rest = rest.join(ratios.where(~often).select(F.col("gram").alias("_gram"), "ratio"), F.col("gram") == F.col("_gram"))
    rest = rest.groupBy(F.col("u").alias("_u")).agg(F.sum(F.col("share") * F.col("ratio")).alias("rest"))
    scored = scored.join(rest, F.col("u") == F.col("_u"), "left")
    return staged(scored.withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0))).drop("_u", "rest"))


_SCORED = "u bigint, url string, allowed boolean, times bigint, held_out boolean, score double"


def calibrate(scored: DataFrame) -> float:
    """Threshold from the held-out labelled URLs: at most ``2,001`` steps reach the driver."""
    step = F.greatest(F.lit(-_STEPS), F.least(F.lit(_STEPS), F.floor(F.col("score") / _STEP))).cast("int")
    rows = scored.where("held_out and allowed is not null").groupBy(step.alias("step")).agg(
        F.sum(F.col("times") * F.col("allowed").cast("long")).alias("a"),
        F.sum(F.col("times") * (~F.col("allowed")).cast("long")).alias("b"),
    ).collect()
    allowed, blocked = np.zeros(2 * _STEPS + 2), np.zeros(2 * _STEPS + 2)
    for r in rows:
        allowed[r["step"] + _STEPS], blocked[r["step"] + _STEPS] = r["a"], r["b"]
    if not allowed.sum() or not blocked.sum():
        return 0.0
    right = (allowed.sum() - np.cumsum(allowed) + allowed) / allowed.sum() + (np.cumsum(blocked) - blocked) / blocked.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 - _STEPS) * _STEP


def judge(pages: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url", hot: int = HOT) -> DataFrame:
    """``id, host, path, rule, verdict, score`` of every row."""
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path("url")
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict).withColumn("url", F.coalesce("url", F.lit("")))
    urls = rows.groupBy("url").agg(F.min("ruled").alias("ruled"), F.count(F.lit(1)).alias("times"))
    urls = staged(urls.select(F.monotonically_increasing_id().alias("u"), "url", (F.col("ruled") == "allow").alias("allowed"), "times"))
    scored = score_urls(urls, hot)
    modelled = F.when(F.col("score") >= calibrate(scored), "allow").otherwise("block")
    return rows.join(scored.select(F.col("url").alias("_url"), "score"), F.col("url") == F.col("_url")).select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("ruled", modelled).alias("verdict"), "score"
    )


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows of ``pages`` whose URL is allowed, unchanged; the verdict depends on the URL alone."""
    good = judge(pages.select(F.col(url).alias("_url"), F.col(url).alias("url")), rules, "_url", "url")
    good = good.where("verdict = 'allow'").select("_url").distinct()
    return pages.join(good, pages[url].eqNullSafe(good["_url"]), "left_semi")
