import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from plain import edge_rows, frame
from tokenizers import Tokenizer

from wakeline.llm import mixing, packing, token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer):
    odd = ["", " ", "  \n\n x", "it's we'LL 12 ３ x²", "a<|endoftext|> b<|endoftext|", "\u00a0\u2003 z\u200b", "日本語 текст \U0001f600", "\r\n\t tab", "x" * 5000]
    for text in odd + [r[1] or "" for r in edge_rows()]:
        assert tokens.encode(PATH, text).tolist() == ids(tokenizer, text)


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(0, 7)))
        room = rng.randint(0, 40)
        sums = {sum(c) for k in range(8) for c in itertools.combinations(list(counts.elements()), k) if sum(c) <= room}
        got = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(sums)


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = Counter(min(1024, int(rng.paretovariate(0.8) * 20)) for _ in range(5000))
    made = packing.plan(counts)
    used = Counter()
    for combination, times in made:
        assert sum(x * n for x, n in combination.items()) <= 1024
        for x, n in combination.items():
            used[x] += n * times
    assert used == counts
    bins = sum(times for _, times in made)
    assert bins <= 1.02 * math.ceil(sum(x * n for x, n in counts.items()) / 1024) + 1


def test_packing_round_trip(spark, tokenizer):
    rows = edge_rows()
    got = packing.pack(frame(spark, rows), capacity=256, with_ids=True).collect()
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    for d, text, *_ in rows:
        want = ids(tokenizer, text) + [2]
        if d is not None and sum(x[0] == d for x in rows) == 1:
            mine = sorted((r.piece, r.start, bytes(r.ids)) for r in got if r.doc_id == d)
            assert np.frombuffer(b"".join(x[2] for x in mine), "<u4").tolist() == want
            assert [x[0] for x in mine] == list(range(len(mine)))
            assert [len(x[2]) // 4 for x in mine[1:]] == [256] * (len(mine) - 1)
    assert sum(r.length for r in got) == sum(len(ids(tokenizer, t)) + 1 for _, t, *_ in rows)
    assert packing.pack(frame(spark, [])).count() == 0


def test_limit_table(spark, tokenizer):
    rows = edge_rows()
    got = token_counts.token_limits(frame(spark, rows)).collect()
    sizes: dict = {}
    for _, text, lang, _ in rows:
        sizes.setdefault(lang, []).append(len(ids(tokenizer, text)))
    assert len(got) == sum(len(set(s)) for s in sizes.values())
    for r in got:
        s, limit = sizes[r.lang], r.context_limit
        assert r.n_docs == s.count(limit)
        assert r.docs_within == sum(x <= limit for x in s) and r.docs_beyond == sum(x > limit for x in s)
        assert r.tokens_within == sum(x for x in s if x <= limit) and r.tokens_beyond == sum(x for x in s if x > limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in s)
        assert r.share_within == pytest.approx(r.docs_within / len(s))
    assert token_counts.token_limits(frame(spark, [])).count() == 0


def test_limit_table_over_many_spans(spark):
    rng = random.Random(4)
    lengths = [int(10 ** rng.uniform(0, 7)) for _ in range(400)]
    histogram = token_counts.length_histogram(spark.createDataFrame([("x", n) for n in lengths], "g string, n_tokens bigint"), ["g"])
    for r in token_counts.limit_table(histogram, ["g"]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths)


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_replication_inverts_the_distribution(spark):
    rows = [(i, "x" * (5 if i % 3 else 50), "en", ("hot", "a", None)[i % 3]) for i in range(900)]
    df = frame(spark, rows)
    weights = {"hot": 3.0, "a": 1.0}
    rates = {r.source: r.rate for r in mixing.repetition_rates(df, weights=weights).collect()}
    total = sum(len(t) for _, t, *_ in rows)
    assert rates["hot"] == pytest.approx(0.75 * total / 15000) and rates[None] == 0.0
    got = Counter(r.doc_id for r in mixing.mix(df, weights=weights).collect())
    draws = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(mixing.F.lit(mixing.SEED), "doc_id", "source").alias("u")).collect()}
    assert all(got[d] == (poisson(rates[s], draws[d]) if rates[s] else 0) for d, _, _, s in rows)
    share = sum(len(t) * got[d] for d, t, _, s in rows if s == "hot") / sum(len(t) * got[d] for d, t, _, s in rows)
    assert share == pytest.approx(0.75, abs=0.05)


def test_large_rates(spark):
    rates = spark.createDataFrame([("a", 900.0)], "source string, rate double")
    df = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id bigint, source string")
    n = Counter(r.doc_id for r in mixing.replicate(df, rates).collect())
    assert len(n) == 40 and 880 < sum(n.values()) / 40 < 920


def test_mixing_odd_rows(spark):
    df = frame(spark, edge_rows())
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "en", "a")])).count() in range(10)


def test_columns_of_the_same_names_stay(spark):
    df = frame(spark, [(i, "some text", "en", "a") for i in range(20)]).selectExpr("*", "doc_id * 7 AS copy", "'mine' AS Shuffle_Key")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "_copy", "_shuffle_key"]
    rows = out.collect()
    assert rows and all(r["copy"] == 7 * r.doc_id and r["Shuffle_Key"] == "mine" for r in rows)
    assert [r._shuffle_key for r in rows] == sorted(r._shuffle_key for r in rows)


def test_any_limit_and_the_whole_corpus(spark):
    rng = random.Random(15)
    rows = [(i, " ".join("word" for _ in range(rng.choice([0, 1, 3, 3, 200, 700]))), rng.choice(["en", "de", None]), "a") for i in range(120)]
    rows += [(500, None, "en", "a"), (501, "one text of a language", "fr", "a")]
    df = frame(spark, rows)
    limits = (0, 2, 150, 1024, 5000)
    size = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(df).collect()}
    table = token_counts.corpus_limits(df, limits=limits)
    got = {(r.lang, r.whole, r.context_limit): r for r in table.collect()}
    assert len(got) == table.count()
    groups = {(lang, False): [size[d] for d, _, x, _ in rows if x == lang] for lang in ("en", "de", None, "fr")}
    groups[None, True] = list(size.values())
    assert set(got) == {(*g, x) for g, held in groups.items() for x in {*held, *limits}}
    for (lang, whole, x), r in got.items():
        held = groups[lang, whole]
        within = [n for n in held if n <= x]
        assert (r.n_docs, r.docs_within, r.tokens_within) == (held.count(x), len(within), sum(within))
        assert r.docs_beyond == len(held) - len(within) and r.tokens_beyond == sum(held) - sum(within)
        assert r.truncated_tokens == sum(min(n, x) for n in held) and abs(r.share_within - len(within) / len(held)) < 1e-12
    cuts = token_counts.quantile_lengths(token_counts.token_limits(df, by=()), (), (0.25, 0.5, 1.0)).collect()
    every = sorted(size.values())
    assert [r.n_tokens for r in cuts] == [every[-(-len(every) * k // 4) - 1] for k in (1, 2, 4)]
    assert token_counts.corpus_limits(frame(spark, [])).count() == 0
