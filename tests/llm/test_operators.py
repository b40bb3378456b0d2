"""The text operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lumatile.llm import components, exact_dedup, fuzzy_lines, html_main, license_scan, mixing, packing, pii, quality_crf, quality_rules, simhash_dedup
from lumatile.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, part string, component_id string"


def table(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{(i or 0) % 3}", None, "u", "p", "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def near_copies(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = base[:]
            copy[r.randrange(200)] = word()
            texts.append("  ".join(copy))
    return list(enumerate(texts))


EDGE = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (904, "A"), (904, "A"), (905, "a b"), (906, "ab"), (None, "ab"), (907, "x " * 30_000), (908, "é\x0bß ü ö"), (909, "\n\n"), (910, "<b>&amp;</b>"), (911, "a <|endoftext|> b")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, near_copies() + EDGE).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


# --- exact dedup --------------------------------------------------------------------------------


@pytest.mark.parametrize("budget", [64 << 20, 4000])
def test_exact_groups(docs, budget):
    """With a small table most rows go through several levels of spill files."""
    groups = defaultdict(list)
    for d in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", d.text or "")].append((-len(d.text or ""), d.doc_id is None, d.doc_id or 0))
    found = exact_dedup.exact_groups(docs, budget).collect()
    assert len(found) == docs.count()
    kept = Counter()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for f in found:
        members = by_sha[f.text_sha256]
        best = min(members)
        assert f.group_size == len(members) and f.keep_id == (None if best[1] else best[2])
        kept[f.text_sha256] += f.kept
    assert set(kept.values()) == {1}
    stay = exact_dedup.exact_dedup(docs, budget)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in stay.collect()) == sorted((f.doc_id is None, f.doc_id) for f in found if f.kept)


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 == exact_dedup.exact_dedup(empty).count()


# --- SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [2048, 2])
def test_near_duplicates(docs, bucket):
    """A bucket of two forces longer keys for hot ones."""
    rows = [d for d in docs.collect() if d.doc_id != 907]
    fp = [brute_fingerprint(d.text) for d in rows]
    root = reach(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    least = defaultdict(lambda: math.inf)
    for d, r in zip(rows, root, strict=True):
        least[r] = min(least[r], math.inf if d.doc_id is None else d.doc_id)
    expected = Counter((d.doc_id, f"{f:016x}", least[r]) for d, f, r in zip(rows, fp, root, strict=True))
    found = simhash_dedup.near_duplicates(docs, bucket)
    assert Counter(tuple(r) for r in found.where("doc_id IS NULL OR doc_id <> 907").collect()) == expected
    assert len({v for v in least.values()}) < len(rows) - 10
    stay = simhash_dedup.one_of_each(docs, bucket)
    assert stay.columns == docs.columns and {r.component_id for r in stay.collect()} == {"c"}
    named = {r.doc_id: r.component_id for r in found.collect()}
    assert {r.doc_id for r in stay.collect()} == {d for d, c in named.items() if d is None or d == c}


def test_near_duplicates_of_nothing_and_null_ids(spark, empty):
    assert simhash_dedup.near_duplicates(empty).count() == 0
    out = simhash_dedup.near_duplicates(table(spark, [(None, "x y"), (None, "x y")])).collect()
    assert [r.component_id for r in out] == [None, None]


def test_one_of_each_tells_rows_of_one_id_apart_by_their_texts(spark):
    near = near_copies(3)
    a = next(x for _, x in near)
    docs = table(spark, [(1, a), (2, a + " "), (2, "nothing like that at all here"), (3, None), (3, "something else is in this one")])
    assert sorted((x.doc_id, x.text or "") for x in simhash_dedup.one_of_each(docs).collect()) == sorted([(1, a), (2, "nothing like that at all here"), (3, ""), (3, "something else is in this one")])


def test_every_link_shares_a_key():
    r = random.Random(4)
    masks = [m for _, _, m in simhash_dedup.keys()]
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        shared = [(i, m) for i, _, m in simhash_dedup.keys() if a & m == b & m]
        assert any(simhash_dedup.viable(np.array([a ^ b], np.uint64), np.array([i]))[0] for i, m in shared)
        assert any(a & m == b & m for _, m in fuzzy_lines.masks())
    assert len(masks) == 8


def test_pigeonring_prunes_only_what_is_too_far():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) & rng.integers(0, 1 << 63, 2000, dtype=np.uint64) & rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    kept = np.zeros(len(x), bool)
    for start in range(4):
        kept |= simhash_dedup.viable(x, np.full(len(x), start))
    assert kept[np.bitwise_count(x) <= 3].all() and not kept.all()


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in list(parent)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 64, 2048])
    counts = Counter(min(cap, max(1, int(r.expovariate(1 / r.uniform(cap / 8, cap))))) for _ in range(r.randint(1, 3000)))
    bins = defaultdict(list)
    for size, runs in packing.plan(counts, cap).items():
        for k, (n, first, per, offset) in enumerate(runs):
            stop = runs[k + 1][0] if k + 1 < len(runs) else counts[size]
            for i in range(stop - n):
                bins[first + i // per].append((offset + i % per * size, size))
    assert Counter(s for b in bins.values() for _, s in b) == counts
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= cap and sum(3 * s > cap for _, s in b) <= 2
    lower = max(-(-sum(s * c for s, c in counts.items()) // cap), sum(c for s, c in counts.items() if 2 * s > cap))
    assert len(bins) <= lower * 11 / 9 + 1
    assert packing.plan({}, cap) == {}


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d.doc_id, n, i, j - i, zlib.crc32(ids[i:j].tobytes())] += 1
    found = packing.pack(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    ends = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    lower = max(-(-sum(ends.values()) // 2048), sum(2 * r.length > 2048 for r in found))
    assert max(ends.values()) <= 2048 and len(ends) <= lower * 11 / 9 + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " \n<|endoftext|>  y <|endoftext", "<<|endoftext|>|>", "x<|endoftext|>", "a" * 5000, " " * 3000, "​﻿ é \U0001f600\U0001f468‍\U0001f469", "\r\n\t  x", "don't WE'LL 123abc", "日本語 テキスト"])
def test_ids_equal_those_of_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert packing.Encoder(*packing.byte_vocab(tokenizer_path())).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts():
    from tokenizers import Tokenizer

    r, t, e = random.Random(15), Tokenizer.from_file(tokenizer_path()), packing.Encoder(*packing.byte_vocab(tokenizer_path()))
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "12", "'s", "'LL", "!?", "\u00a0", "\u3000", "日", "\U0001f600", "\x00", "\x85"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 20)))
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


# --- mixing -------------------------------------------------------------------------------------


def test_targets():
    out = mixing.targets({"a": 100, "b": 100, "c": 100, None: 100})
    # Weights 5, 2, 1, 5 of 600: a and null stop at 200, the other 200 go 2 to 1.
    assert out == pytest.approx({"a": 200, None: 200, "b": 400 / 3, "c": 200 / 3})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


@pytest.mark.parametrize("seed", range(20))
def test_apportionment_equals_quotient_by_quotient(seed):
    r = random.Random(seed)
    shares = np.array([r.choice([0, r.random() * 10, r.randint(1, 9)]) for _ in range(r.randint(1, 9))])
    most = np.array([r.randint(0, 60) for _ in shares])
    blocks = r.randint(0, 120)
    quota = np.zeros(len(shares), int)
    for _ in range(blocks):
        q = np.where((quota < most) & (shares > 0), shares / (2 * quota + 1), -1)
        if q.max() <= 0:
            break
        quota[np.argmax(q)] += 1
    assert mixing.apportion(shares, blocks, most).tolist() == quota.tolist()


def test_mix(spark, empty):
    r = random.Random(7)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 40, 500, 3000])), None if i % 7 == 0 else f"s{'abcd'[min(i % 6, 3)]}") for i in range(400)] + [(0, None, None), (1, "w w", "tiny"), (1, "w w", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, shard=20_000)
    first = sorted(map(str, out.collect()))
    assert len(first) == len(rows) and first == sorted(map(str, mixing.mix(docs.repartition(7), shard=20_000).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, took = mixing.targets(sizes), Counter()
    for x in out.collect():
        assert x.taken <= 2 * x["size"] and x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert sum(s["last"] - s["first"] for s in x.spans) == x.taken
        took[x.source] += x.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(64 * 20, 0.02 * want[s])
    words = Counter()
    for x in mixing.mixed(docs, shard=20_000).collect():
        words[x.source] += len(x.text.split())
    assert words == Counter({s: n for s, n in took.items() if n})
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_a_small_source_reaches_its_target_over_many_shards(spark):
    rows = [(i, " ".join(["w"] * 400), f"big{i % 5}") for i in range(2000)] + [(10_000 + i, " ".join(["w"] * 15), "tiny") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tiny = [x for x in mixing.mix(docs, shard=4_000).collect() if x.source == "tiny"]
    assert tiny[0].target == 12_000 and abs(sum(x.taken for x in tiny) - 12_000) <= 128
    assert sum(len(x.text.split()) for x in mixing.mixed(docs, shard=4_000).where("source = 'tiny'").collect()) == sum(x.taken for x in tiny)


def test_many_sources_get_the_same_table_from_spark(spark):
    r = random.Random(16)
    rows = [(i, f"s{r.randint(0, 300)}" if i % 9 else None, r.choice([0, 3, 50, 900, 20_000])) for i in range(2000)] + [(-1, "", 7), (-2, "\U0001f600", 5), (-3, "\uffff", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    small, total = mixing._sources(sizes, (5, 2, 1), 1.5, 2)
    large, again = mixing._sources(sizes, (5, 2, 1), 1.5, 2, few=10)
    a, b = ({x.source: x for x in d.collect()} for d in (small, large))
    assert total == again == sum(x[2] for x in rows) and a.keys() == b.keys() and len(a) > 250
    assert all((a[k].rank, a[k].source_size) == (b[k].rank, b[k].source_size) and b[k].target == pytest.approx(a[k].target) for k in a)
    assert sorted(a, key=lambda k: a[k].rank) == sorted(a, key=lambda k: (k is None, k or ""))
    assert mixing._sources(sizes.where("size < 0"), (5, 2, 1), 1.5, 2, few=-1)[1] == 0


def test_cut_keeps_what_stands_between_words():
    assert mixing._cut("  a  b\nc d ", 4, [(0, 4)]) == "  a  b\nc d "
    assert mixing._cut("  a  b\nc d ", 4, [(0, 2), (3, 4)]) == "a  b\nd"


# --- quality ------------------------------------------------------------------------------------


def test_quality_rules(docs, empty):
    expected = Counter()
    for d in docs.collect():
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected[d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    found = quality_rules.quality_rules(docs).collect()
    assert Counter(tuple(q)[:7] for q in found) == expected
    assert not any(q.kept and q.base_failed for q in found)
    assert quality_rules.quality_rules(empty).count() == 0


def brute_verdicts(rows):
    """kept by doc_id, from (doc_id, lang, text): histograms, references and distances in plain Python."""
    marks = ".,;:?!'\"()-#*$%&|<>"
    kinds = [set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"), set(" \t\n\x0b\x0c\r"), set(".,;:?'\"()-"), set("!"), set("#*$%&|<>")]
    vocab = sorted({w for words in quality_rules.COMMON.values() for w in words})
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)

    def shares(counts):
        return [n / max(1, sum(counts)) for n in counts]

    def far(p, q):
        return math.sqrt(max(0, sum(x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x > 0) / 2))

    def mean(values):
        return [round(sum(c) / len(values), 9) for c in zip(*values, strict=True)]

    docs = {}
    for i, lang, t in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        n = [sum(c in k for c in t) for k in kinds]
        high = sum(ord(c) > 127 for c in t)
        words = Counter(lower(x.strip(marks)) for x in w)
        common = [words[v] for v in vocab]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        docs[i] = (lang, len(w), sum(map(len, w)), len(w) < 20 or 100 * len(again) > 30 * len(w), shares([*n, high, len(t) - sum(n) - high]), shares([*common, len(w) - sum(common)]), 100 * len(again) <= 30 * len(w))
    refs = {}
    for lang in quality_rules.COMMON:
        good = [d for d in docs.values() if d[0] == lang and d[1] >= 50 and d[6]]
        if good:
            p, q = mean([d[4] for d in good]), mean([d[5] for d in good])
            away = [far(d[4], p) + far(d[5], q) for d in good]
            half = sorted(away)[(len(away) + 1) // 2 - 1]
            refs[lang] = tuple(mean([d[k] for d, x in zip(good, away, strict=True) if x <= half]) for k in (4, 5))
    out = {}
    for i, (lang, n, chars, failed, p, q, _) in docs.items():
        near = [refs[lang]] if lang in refs else list(refs.values())
        strange = near and (chars >= 200 and min(far(p, r[0]) for r in near) > 0.20 + 2 / math.sqrt(chars) or n >= 50 and min(far(q, r[1]) for r in near) > 0.12 + 3 / math.sqrt(n))
        out[i] = not failed and not strange
    return out


def test_verdicts_equal_brute_force_on_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(x) for x in d.select("doc_id", "lang", "text").collect()] + [(-1, None, "the " * 30 + "of and zzz " * 60), (-2, "xx", "und " + "q%d " * 90 % tuple(range(90))), (-3, "en", None)]
    found = {q.doc_id: q.kept for q in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert found == brute_verdicts([(i, lang, t) for i, lang, t in rows]) and 0 < sum(found.values()) < len(found)


def test_texts_without_common_words_or_of_another_language_fail(spark):
    """Long gibberish and swapped languages go by the common-word histogram alone; texts of their language stay at every length."""
    r = random.Random(22)

    def text(lang, n):
        words = quality_rules.COMMON[lang]
        return " ".join(r.choice(words) if lang and r.random() < 0.27 else "".join(r.choice("abcdeginorstu") for _ in range(r.randint(2, 9))) for _ in range(n))

    rows = [(1000 * k + i, lang, text(lang, r.choice([20, 60, 120, 400, 2000]))) for k, lang in enumerate(quality_rules.COMMON) for i in range(60)]
    swapped = [(9000 + i, a, text(b, 400)) for i, (a, b) in enumerate((a, b) for a in quality_rules.COMMON for b in quality_rules.COMMON if a != b)]
    gibberish = [(9500 + i, lang, " ".join("".join(r.choice("abcdeginorstu") for _ in range(r.randint(5, 9))) for _ in range(n))) for i, (lang, n) in enumerate((lang, n) for lang in (*quality_rules.COMMON, None) for n in (200, 2000))]
    out = {q.doc_id: q for q in quality_rules.quality_rules(spark.createDataFrame(rows + swapped + gibberish, "doc_id long, lang string, text string")).collect()}
    assert [i for i, _, _ in rows if not out[i].kept and not out[i].base_failed] == []
    assert [i for i, _, _ in swapped + gibberish if out[i].kept] == []


def test_divergence_drops_what_is_unlike_its_language(spark):
    r = random.Random(8)
    common = ["the", "of", "and", "to", "in", "is", "that"]
    text = lambda: " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("aeinorst") for _ in range(6)) for _ in range(120))
    rows = [(i, text()) for i in range(40)] + [(100, text().upper()), (101, " ".join(w + "***" for w in text().split())), (102, "short but fine text")]
    out = {q.doc_id: q for q in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(out[i].kept for i in range(40)) and not out[100].kept and not out[101].kept and out[102].class_distance is not None
    alone = quality_rules.quality_rules(table(spark, [(1, text())], lang="xx")).first()
    assert alone.class_distance is None and alone.kept


@pytest.mark.parametrize("seed", range(5))
def test_jensen_shannon(spark, seed):
    rng = np.random.default_rng(seed)
    p, q = rng.dirichlet([0.3] * 6), rng.dirichlet([0.3] * 6)
    p[0] = 0
    p /= p.sum()
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    row = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    assert row.select(quality_rules.jensen_shannon(F.col("p"), F.col("q"))).first()[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_forward_backward_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(9)
    emit, move = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2))
    lengths = np.array([4, 3])
    marginals, moves, log_z = quality_crf.forward_backward(emit, move, lengths)
    for d, n in enumerate(lengths):
        paths = {p: math.exp(sum(emit[d, t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product((0, 1), repeat=int(n))}
        z = sum(paths.values())
        assert log_z[d] == pytest.approx(math.log(z))
        for t in range(n):
            assert marginals[d, t, 1] == pytest.approx(sum(v for p, v in paths.items() if p[t]) / z)
        assert moves[d, 0, 1] == pytest.approx(sum(v * sum((a, b) == (0, 1) for a, b in zip(p, p[1:], strict=False)) for p, v in paths.items()) / z)


def test_long_and_short_documents_share_a_batch():
    """Padding of thousands of lines leaves scores and weights finite, and no score depends on the batch."""
    r = random.Random(21)
    line = lambda bad: " ".join(("***" if bad and r.random() < 0.5 else "") + "".join(r.choice("abcdef") for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 12)))
    sizes = [1, 2, 3, 900, 1100, 5000, 20_000, 0] + [r.randint(1, 30) for _ in range(60)]
    labels = [i % 2 for i in range(len(sizes))]
    texts = ["\n".join(line(not y) for _ in range(n)).encode() for n, y in zip(sizes, labels, strict=True)]
    pairs = [quality_crf.line_features(t) for t in texts]
    use, short = [i for i, n in enumerate(sizes) if n], [i for i, n in enumerate(sizes) if 0 < n <= 5000]
    model = quality_crf.fit([pairs[i][0] for i in short], [labels[i] for i in short], steps=40)
    assert all(np.isfinite(model[k]).all() for k in ("w", "move"))
    together = quality_crf.scores(model, [p[0] for p in pairs], [p[1] for p in pairs])
    alone = [quality_crf.scores(model, [p[0]], [p[1]])[0] for p in pairs]
    assert np.allclose(together, alone, rtol=0, atol=1e-9) and np.isfinite(together).all()
    assert ((together > 0.5) == np.array(labels, bool))[use].mean() > 0.95
    lengths = [len(p[0]) for p in pairs]
    assert sorted(i for run in quality_crf._runs(lengths, 4000) for i in run) == use
    assert all(len(run) == 1 or len(run) * max(lengths[i] for i in run) <= 4000 for run in quality_crf._runs(lengths, 4000))


def test_training_lines_are_bounded(spark):
    rows = [(i, "\n".join(["good words here"] * (5000 if i == 1 else 3)) if i % 2 else "*** ### ***") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_crf.train(docs, labels, lines=10_000)
    out = {x.doc_id: x.score for x in quality_crf.classify(docs, model).collect()}
    assert all((s > 0.5) == (i % 2 == 1) for i, s in out.items())


def test_classifier_holds_out_and_generalises(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_crf.train(d, labels)
    again = quality_crf.train(d.repartition(5), labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.allclose(model["w"], again["w"])  # held-out labels aren't seen
    out = quality_crf.classify(d, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95
    good, bad = out.score[out.quality == 1], out.score[out.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.97
    scored = quality_crf.classify(docs, model).collect()
    assert len(scored) == docs.count() and {s.score for s in scored if s.doc_id in (900, 901, 902, 909)} == {0.0}
    assert all(s.held_out == (s.doc_id is not None and zlib.crc32(str(s.doc_id).encode()) % 5 == 0) for s in scored)
    kept = quality_crf.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s.predicted for s in scored)
    assert quality_crf.classify(empty, model).count() == 0
    nothing = quality_crf.train(empty, labels)
    assert quality_crf.classify(docs, nothing).count() == docs.count()


# --- personal data ------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_base_spans_and_method(spark, empty):
    r = random.Random(10)
    made = ["".join(r.choice("ab1205.@+ -()é%_") for _ in range(60)) for _ in range(400)]
    texts = made + ["a@b.cd_x@e.f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "+1 (487) 555-7209 +12 4111 1111 1111 1111 é 4111-1111-1111-1111", "", None, "1" * 30_000, "+1" + " " * 30_000, "@" * 9000, "no numbers here at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.pii_digest(docs).collect():
        expected = base_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(row.spans.split(",") if row.spans else [])
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s.startswith(k + ":") for s in expected) for k in PATTERNS)
    assert pii.pii_digest(empty).count() == 0


def test_pii_method_finds_secrets_and_leaves_clean_text(spark):
    found = [("token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "secret"), ("my ssn 123-45-6789 ok", "number"), ("call (555) 123-4567 now", "number"), ("IBAN DE12 3456 7890 1234 5678 90 ok", "account"), ("mail bob [at] site [dot] com", "contact")]
    clean = ["built on 2024-01-31 in 2019", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "see isbn 978-3-1614-8410-0", "a very-long-hyphenated-word-2024-indeed here", "order 12345678901234567", "he looked at the dot and the line"]
    docs = spark.createDataFrame(list(enumerate([t for t, _ in found] + clean)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, (_, kind) in enumerate(found):
        assert [s.kind for s in rows[i].added] == [kind]
    assert [r.doc_id for r in rows.values() if r.doc_id >= len(found) and (r.added or r.base)] == []
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[1] == "my ssn <number> ok" and out[len(found)] == clean[0]


def spans_by_other_rules(seed, n):
    """(kind, before, hit, after, personal): formats written down here, not those that the trees were fitted to."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    c = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    w = lambda: r.choice("river garden window market little yellow history of the to winter under people station".split())
    for _ in range(n):
        lead = f"{w()} {w()} {w()} "
        right, wrong = {
            "secret": (
                [('password: "', c(base64, 22), '"'), ("AWS_SECRET=", c(base64 + "+/", 40), " "), ("export API_KEY='", c("0123456789abcdef", 32), "'"), ("Authorization: Bearer ", c(base64 + "-_", 70), " "), ("use ", "ghp_" + c(base64, 36), " to push"), ("key ", "AKIA" + c("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), " "), ('token = "', c("0123456789abcdef", 40), '"')],
                [("commit ", c("0123456789abcdef", 40), " fixed it"), ("see ", "a-rather-long-hyphenated-word-for-it", " "), ("", "-" * 30, " "), ("", "Donaudampfschifffahrtsgesellschaft", " ist"), ("path ", "usr/local/lib/python3/site-packages", "/x"), ("", d(20), " grains"), ("", "some_function_name_v2_final", "(")],
            ),
            "number": (
                [("call ", f"({d(3)}) {d(3)}-{d(4)}", " today"), ("tel: ", f"{d(3)}.{d(3)}.{d(4)}", ""), ("reach me on ", f"{d(3)}-{d(3)}-{d(4)}", "."), ("SSN ", f"{d(3)}-{d(2)}-{d(4)}", ","), ("whatsapp ", f"0{d(2)} {d(7)}", " ")],
                [("on ", f"{r.randint(1950, 2025)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", " "), ("from ", f"{r.randint(1950, 1999)} {r.randint(2000, 2025)}", " "), ("ISBN ", f"978-0-{d(3)}-{d(5)}-{d(1)}", " "), ("about ", f"{r.randint(10, 99)}.{d(3)}.{d(3)}", " people"), ("id ", d(12), " "), ("pi is 3.", d(30), " "), ("order ", d(9), " ")],
            ),
            "account": (
                [("IBAN ", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", " "), ("to ", f"FR{d(2)}{d(20)}{d(3)}", "."), ("account ", f"ES{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", ","), ("IBAN: ", f"NL{d(2)}ABNA{d(10)}", " ")],
                [("part ", "AB12" + c("ABCDEFGHJK", 10), " "), ("", "AC45 WITH MANY OTHER LOUD WORDS HERE", " "), ("model ", f"XR{d(2)}" + c("ABCDEF", 8), " ")],
            ),
            "contact": (
                [("mail ", f"jane.{w()} at {w()}mail dot com", " "), ("write to ", f"{w()}{d(2)}[at]{w()}[dot]org", "."), ("", f"info (at) {w()} (dot) de", ","), ("ask ", f"{w()} AT {w()} DOT net", " ")],
                [("he ", "looked at the dot and", " then"), ("", "arrived at noon dot after", " that"), ("we ", "met at Dot and", " went"), ("", "stay at a dot on", " the map")],
            ),
        }[kind := r.choice(["secret", "number", "account", "contact"])]
        personal = r.random() < 0.5
        before, hit, after = r.choice([x for x in (right if personal else wrong) if x[1]])
        yield kind, lead + before, hit, after + f" {w()} {w()}", personal


def test_recall_and_precision_on_spans_made_by_other_rules(spark):
    made = list(spans_by_other_rules(23, 3000))
    docs = spark.createDataFrame([(i, b + h + a) for i, (_, b, h, a, _) in enumerate(made)], "doc_id long, text string")
    hit, miss, false = Counter(), Counter(), Counter()
    for row in pii.find_pii(docs).collect():
        kind, before, text, _, personal = made[row.doc_id]
        found = any(s.start < len(before) + len(text) and len(before) < s.stop for s in (*row.added, *row.base))
        (hit if found else miss)[kind] += personal
        false[kind] += found and not personal
    for kind in pii.CANDIDATES:
        assert hit[kind] + miss[kind] > 100
        assert hit[kind] / (hit[kind] + miss[kind]) >= 0.9 and hit[kind] / (hit[kind] + false[kind]) >= 0.9, (kind, hit, miss, false)


def test_planted_secrets_of_a_whole_table_are_found_and_other_documents_left_alone(spark):
    rows = {d.doc_id: d.text or "" for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = pii.find_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    planted = 0
    for row in out:
        text = rows[row.doc_id]
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text):
            planted += 1
            assert any(s.kind == "secret" and (s.start, s.stop) == m.span(1) for s in row.added)
        if not re.search(r'token = "|@|[0-9]{7}|[0-9]\.[0-9]|[0-9]{4}', text):
            assert not row.added and not row.base
    assert planted > 5


def test_many_matches_in_one_text(spark):
    """100,000 matches take time in proportion, and overlapping candidates of a long list are told apart as in Python."""
    email, secret = "ab@cd.ef ", 'token = "0123456789abcdef0123456789abcdef01234567" '
    rows = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(0, email * 100_000), (1, (email + secret) * 1000)], "doc_id long, text string")).collect()}
    assert [s.start for s in rows[0].base] == list(range(0, 900_000, 9)) and not rows[0].added
    step = len(email + secret)
    assert [(s.start, s.stop) for s in rows[1].added] == [(k * step + 18, k * step + 58) for k in range(1000)] and len(rows[1].base) == 1000


def test_boosted_trees_in_sql_equal_those_in_python(spark):
    model = pii.fit()
    examples = [e for e in pii.synthetic(60, seed=77) if e[0] == "number"]
    trees, limit = model["number"]
    right = sum((sum(pii.STEP * pii._value(t, pii.features_of(*e[1:4])) for t in trees) >= limit) <= e[4] for e in examples)
    assert right / len(examples) >= 0.95
    docs = spark.createDataFrame([(i, e[2] + e[1] + e[3]) for i, e in enumerate(examples)], "doc_id long, text string")
    for row in pii.find_pii(docs, {k: (t, limit if k == "number" else float("inf")) for k, (t, _) in model.items()}).collect():
        _, hit, before, after, _ = examples[row.doc_id]
        whole = [s for s in row.added if (s.start, s.stop) == (len(before), len(before) + len(hit))]
        if whole:
            assert sum(pii.STEP * pii._value(t, pii.features_of(hit, before, after)) for t in trees) >= limit


# --- pages --------------------------------------------------------------------------------------


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 4])
def test_common_lines(bits):
    r = random.Random(11)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        for found in (html_main.common_lines(a, b), html_main._align(a, b, bits)):
            assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found)
            assert all(p < q for (p, _), (q, _) in zip(found, found[1:], strict=False)) and all(p < q for (_, p), (_, q) in zip(found, found[1:], strict=False))


def test_page_lines():
    page = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav>N</nav><!-- <p>c --><article><header><h1>A &amp; B&#33;</h1></header><p>x <b>y</b>z<br>w<p>1 < 2 &lt;p&gt;<form>f</form><aside>s</aside><div class="social share">S</div><section id="comments"><p>C</section></article><div class=cookie-notice>K</div><footer>&copy; F</footer></body></html>'
    lines, kinds = html_main.lines_of(page)
    assert html_main.main_lines(lines, kinds, None) == ["A & B!", "x yz w", "1 < 2 <p>"]
    assert html_main.lines_of("") == ([], []) and html_main.lines_of("<p>a<p") == (["a"], [0]) and html_main.lines_of("<script>x") == ([], [])
    assert html_main.lines_of("a\n  b<div>c</div>")[0] == ["a b", "c"]


def test_pages(spark):
    article = lambda i: f"<article><h1>Title {i}</h1><p>shared sentence</p><p>text {i}</p></article>"
    site = lambda i: f"<div>Welcome to the site</div><p>own text {i}</p><div>All rights</div>"
    rows = [(i, f"https://www.h{i % 2}.org:80/a/{i}?q=1", article(i)) for i in range(40)] + [(100 + i, f"http://plain.org/x/{i}", site(i)) for i in range(9)]
    rows += [(200, None, None), (201, "not a url", "<p>only"), (202, "http://alone.org/", site(1)), (203, "http://copies.org/1", site(2)), (204, "http://copies.org/2", site(2)), (205, "", ""), (203, "http://copies.org/1", site(2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r.page_id: r for r in html_main.extract(pages).collect()}
    assert html_main.extract(pages).count() == len(rows)
    assert all(out[i].text == f"Title {i}\nshared sentence\ntext {i}" for i in range(40))
    assert all(out[100 + i].text == f"own text {i}" for i in range(9))
    assert (out[200].text, out[201].text, out[205].text) == ("", "only", "") and out[202].text.startswith("Welcome")
    assert out[203].text == out[204].text and "Welcome" in out[203].text and "own text 2" in out[203].text and out[203].n_chars == len(out[203].text)
    assert html_main.extract(pages.where("page_id < 0")).count() == 0


def brute_pages(rows):
    """The text of each page: sorted by host, path, content, id, each compared with the nearer of the nearest pages that aren't copies."""
    keyed = sorted({(*html_main.split_url(u or ""), h, i, u, t or "") for i, u, t, h in rows}, key=lambda k: html_main.order_of(k[:4]))
    out = {}
    for n, (host, path, h, i, u, t) in enumerate(keyed):
        before = next((k for k in keyed[:n][::-1] if k[2] != h or k[0] != host), None)
        after = next((k for k in keyed[n + 1 :] if k[2] != h or k[0] != host), None)
        near = [k for k in (before, after) if k and k[0] == host]
        other = max(near, key=lambda k: html_main.nearness(path, k[1])) if near else None
        lines, kinds = html_main.lines_of(t)
        theirs = html_main.lines_of(other[5])[0] if other else []
        d = [[0] * (len(theirs) + 1) for _ in range(len(lines) + 1)]
        for x in range(len(lines) - 1, -1, -1):
            for y in range(len(theirs) - 1, -1, -1):
                d[x][y] = d[x + 1][y + 1] + 1 if lines[x] == theirs[y] else max(d[x + 1][y], d[x][y + 1])
        x = y = 0
        shared = set()
        while x < len(lines) and y < len(theirs):
            if lines[x] == theirs[y]:
                shared.add(x)
                x, y = x + 1, y + 1
            elif d[x + 1][y] >= d[x][y + 1]:
                x += 1
            else:
                y += 1
        plain = {x for x, k in enumerate(kinds) if k == html_main.PLAIN}
        gone = set() if plain and plain <= shared else shared
        out[i, u, t] = "\n".join(v for x, (v, k) in enumerate(zip(lines, kinds, strict=True)) if k == html_main.ARTICLE or (k == html_main.PLAIN and html_main.ARTICLE not in kinds and x not in gone))
    return out


def test_whole_pages_equal_brute_force_for_any_partitioning(spark):
    """Sites with menus of their own, copies in a row, one host with most pages, pages with and without articles, up to 2,000 lines."""
    r = random.Random(31)
    rows = []
    for i in range(300):
        host = "big" if i % 3 else f"h{i % 7}"
        menu = "".join(f"<div>{host} menu {k}</div>" for k in range(6))
        text = "".join(f"<p>own {i} {k}</p>" for k in range(r.randint(0, 9)))
        body = f"<article>{text}</article><div>{host} beside</div>" if i % 5 == 0 else text
        page = f"<p>error at {host}</p><p>try again</p>" if i % 4 == 1 else menu + body + f"<div>{host} end</div>"
        rows.append((i, f"http://{host}.org/{r.choice('abc')}/{r.randint(0, 40)}", page))
    rows += [(900, "http://big.org/a/7", "".join(f"<p>line {k}</p>" for k in range(2000))), (901, "http://big.org/a/8", "".join(f"<p>line {k if k % 3 else -k}</p>" for k in range(2000))), (902, None, None), (903, "http://big.org/a/7", ""), (5, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hashed = [(*x[:2], x[2], x[3]) for x in pages.select("page_id", "url", "html", F.xxhash64(F.coalesce("html", F.lit("")))).collect()]
    expected = Counter((i, u, t) for (i, u, _), t in brute_pages(hashed).items())
    changed = 0
    for number, size in ((1, 32 << 20), (7, 4000), (200, 1), (3, 100)):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        try:
            found = html_main.extract(pages.repartition(1 + number % 5), size).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert Counter((f.page_id, f.url, f.text) for f in found) == expected, number
    for i, u, t in rows:
        changed += expected[i, u, "\n".join(html_main.main_lines(*html_main.lines_of(t or ""), None))] == 0
    assert changed > 100  # differencing decides there


def test_class_words_do_not_switch_off_the_main_part():
    page = '<body class="search no-sidebar"><main class="content notice"><article class="post category-social">A<div class="share">s</div><p>B</p><article class="comment">c</article></article></main></body>'
    assert html_main.main_lines(*html_main.lines_of(page), None) == ["A", "B"]
    assert html_main.main_lines(*html_main.lines_of("<body><main hidden>x</main><p>y</p></body>"), None) == ["y"]


# --- licenses -----------------------------------------------------------------------------------


def test_template_automata():
    s = license_scan.Scanner({"t": ("alpha [[beta [[gamma]]]] {{2}} delta",)})
    scan = lambda t: s.scan(t.encode().split(), set(t.encode().split()))
    for t, end in (("alpha x delta", 3), ("alpha beta x y delta", 5), ("alpha beta gamma x delta", 5), ("alpha gamma x delta", 4), ("q alpha x delta", 4)):
        assert scan(t) and scan(t)[0][1] == end, t
    for t in ("alpha delta", "alpha x y z delta", "alpha x", "beta x delta"):
        assert scan(t) == [], t
    with pytest.raises(ValueError):
        license_scan.Scanner({"t": ("[[a]]",)})
    with pytest.raises(ValueError):
        license_scan.compile_template("[[a")


def test_licenses(spark, docs, empty):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "under the mit the license", "Permission is hereby granted, free of charge, to any person", "under-the MIT/license under the mit license", "ünder the mit license", None, ""]
    out = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].labels) == (1, 1, "mit") and out[0].score == 1.0
    assert out[1].base_labels == "apache-2,cc-by-nc" and out[1].labels == "apache-2,cc-by-nc" and (out[1].first_word, out[1].last_word) == (3, 10)
    assert out[2].n_base == 0 and out[3].labels == "" and out[4].n_base == 2 and out[5].n_base == 0 and out[6].score == out[7].score == 0
    for d, r in zip(docs.orderBy("doc_id", "text").collect(), license_scan.scan_licenses(docs).orderBy("doc_id", "n_words").collect(), strict=True):
        assert r.n_words == len(regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), d.text or "")))
    assert license_scan.scan_licenses(empty).count() == 0


def as_regex(template):
    """A template as a regular expression over words that are each followed by a space."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)
    return re.compile("(?:^|(?<= ))" + "".join("(?:" if p == "[[" else ")?" if p == "]]" else rf"(?:\S+ ){{1,{p[2:-2]}}}" if p[0] == "{" else re.escape(p) + " " for p in parts))


def test_whole_scans_equal_regular_expressions(spark):
    """Every column over a whole table, and whole licenses in which one mandatory word is changed, missing, or doubled."""
    r = random.Random(24)
    texts = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for k, wordings in enumerate(license_scan.TEMPLATES.values()):
        for n, wording in enumerate(wordings):
            full = re.sub(r"\{\{\d+\}\}", "Someone Else", wording) if "{{1}}" not in wording else re.sub(r"\{\{\d+\}\}", "3", wording)
            full = full.replace("[[", " ").replace("]]", " ").split()
            bare = re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\{\{\d+\}\}", "3", wording))).split()
            i = r.randrange(len(full))
            for v, w in enumerate((full, bare, full[:i] + ["other"] + full[i + 1 :], full[:i] + full[i + 1 :], full[:i] + full[i : i + 1] * 2 + full[i + 1 :], full[:-1], ["the"] * 1500 + full + ["end"] * 1500)):
                texts.append((10_000 + 100 * k + 10 * n + v, "Copyright 2020. " + ", ".join(x.upper() if r.random() < 0.3 else x for x in w) + "."))
    rules = {label: [as_regex(t) for t in ts] for label, ts in license_scan.TEMPLATES.items()}
    expected = {}
    for i, t in texts:
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        line = "".join(w + " " for w in words)
        starts, base = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        labels = base | {label for label, rs in rules.items() if any(x.search(line) for x in rs)}
        expected[i] = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)))
    found = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {f.doc_id: tuple(f)[1:7] for f in found} == expected
    assert all((f.score > 0.5) == bool(f.labels) or f.score == 0.5 and f.labels for f in found)
    named = Counter(x for _, *_, labels in expected.values() for x in labels.split(","))
    assert set(named) >= set(license_scan.TEMPLATES)


# --- lines --------------------------------------------------------------------------------------


def test_edit_distance():
    r = random.Random(12)
    for _ in range(1500):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 11))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                diagonal, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, diagonal + (x != y))
        assert fuzzy_lines.edit_distance(a, b) == d[-1]
        for most in (0, 2, 5):
            assert (fuzzy_lines.edit_distance(a, b, most) <= most) == (d[-1] <= most)
        assert fuzzy_lines.similar(a.encode(), b.encode()) == (d[-1] <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_shared_grams_never_rule_out_similar_lines():
    r = random.Random(26)
    x, y = [], []
    for _ in range(4000):
        a = "".join(r.choice("abcé \U0001f600") for _ in range(r.randint(0, 40)))
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 3)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "a", "éb"])
        x.append(a)
        y.append("".join(b))
    near = fuzzy_lines.may_be_similar(x, y)
    alike = np.array([fuzzy_lines.similar(p.encode(), q.encode()) for p, q in zip(x, y, strict=True)])
    assert near[alike].all() and 500 < alike.sum() < near.sum() < 4000


def test_line_simhash_over_many_words():
    lines = [b"a b c", b"", b" ".join(b"w%d" % i for i in range(700)), b"x"]
    for line, f in zip(lines, fuzzy_lines.simhashes(lines).tolist(), strict=True):
        h = [xxhash.xxh3_64_intdigest(w) for w in set(line.split())]
        assert f == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fuzzy_lines(spark, empty):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    pool = [" ".join(word() for _ in range(r.choice([1, 3, 40, 60]))) for _ in range(40)]

    def vary(line):
        w = line.split()
        if len(w) > 10 and r.random() < 0.5:
            w[r.randrange(len(w))] += "x"
        return (" ".join(w).upper() + "!" if r.random() < 0.3 else " ".join(w)) + r.choice(["", " ", "."])

    texts = [(i, "\n".join(vary(r.choice(pool)) for _ in range(6)) + "\n\n") for i in range(40)] + [(None, pool[2]), (50, None), (51, ""), (52, "---"), (53, "***\n---"), (1, pool[2])]
    docs = table(spark, texts)
    hashes = {x.text: x.th for x in spark.createDataFrame([(t or "",) for _, t in texts], "text string").withColumn("th", F.xxhash64(F.col("text").cast("binary"))).collect()}
    order = sorted(((i is None, i or 0, hashes[t or ""]), t or "", i) for i, t in texts)
    places = [(k, n, fuzzy_lines.normalised(line)) for k, (_, t, _) in enumerate(order) for n, line in enumerate(t.encode().split(b"\n")) if fuzzy_lines.normalised(line)]
    fp = fuzzy_lines.simhashes([p[2] for p in places]).tolist()
    root = reach(len(places), lambda i, j: places[i][2] == places[j][2] or (fp[i] ^ fp[j]).bit_count() <= 3 and fuzzy_lines.similar(places[i][2], places[j][2]))
    keep = {places[i][:2] for i, x in enumerate(root) if i == x}
    expected = Counter((i, "\n".join(line for n, line in enumerate(t.split("\n")) if (k, n) in keep or not fuzzy_lines.normalised(line.encode()))) for k, (_, t, i) in enumerate(order))
    found = fuzzy_lines.dedup_lines(docs).collect()
    assert Counter((f.doc_id, f.text) for f in found) == expected
    assert len(keep) < len({p[2] for p in places}) and sum(f.n_dropped for f in found) == len(places) - len(keep)
    again = fuzzy_lines.dedup_lines(docs.unionByName(docs))
    assert again.agg(F.sum("n_lines") - F.sum("n_dropped")).first()[0] == len(keep)
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def test_lines_with_edits_are_linked(spark):
    """Pairs of lines that differ in one letter (edits 0) or in so many words: of those that brute force calls similar, nearly all are linked."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9)))
    shares = {(3, 0): 0.9, (6, 0): 0.95, (10, 0): 0.97, (10, 1): 0.95, (28, 1): 0.97, (28, 3): 0.9, (60, 4): 0.95}
    pairs = []
    for words, edits in shares:
        for _ in range(150):
            w = [word() for _ in range(words)]
            x = w[:]
            for i in r.sample(range(words), edits or 1):
                x[i] = word() if edits else x[i] + "q"
            pairs.append(((words, edits), " ".join(w), " ".join(x)))
    alike = {k: p[0] for k, p in enumerate(pairs) if fuzzy_lines.similar(p[1].encode(), p[2].encode())}
    rows = [(2 * k + n, p[n + 1]) for k, p in enumerate(pairs) for n in range(2)]
    got = {f.doc_id: f.n_dropped for f in fuzzy_lines.dedup_lines(table(spark, rows), grams=True).collect()}
    for kind, share in shares.items():
        own = [k for k in alike if alike[k] == kind]
        assert len(own) > 40 and sum(got[2 * k + 1] for k in own) >= share * len(own)
    assert sum(got.values()) <= len(alike)


def test_hot_keys_in_pairs_of_blocks_give_the_same_lines(spark, monkeypatch):
    """A family of a thousand lines in blocks of 50; the result doesn't depend on the blocks."""
    r = random.Random(25)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9)))
    base = [word() for _ in range(30)]
    lines = [" ".join(w if r.random() > 0.04 else word() for w in base) for _ in range(1000)] + [" ".join(word() for _ in range(12)) for _ in range(500)]
    docs = table(spark, [(i, "\n".join(lines[i::100])) for i in range(100)]).repartition(3)
    monkeypatch.setattr(fuzzy_lines, "OFTEN", 2)
    few = {f.doc_id: f.text for f in fuzzy_lines.dedup_lines(docs, grams=True, block=50).collect()}
    many = {f.doc_id: f.text for f in fuzzy_lines.dedup_lines(docs, grams=True).collect()}
    assert few == many and sum(len(t.split("\n")) for t in many.values() if t) <= 510


def _edit_distances_agree(pairs):
    found = fuzzy_lines.all_similar([x for x, _ in pairs], [y for _, y in pairs])
    assert found.tolist() == [fuzzy_lines.similar(x, y) for x, y in pairs]
    return found


def test_edit_distances_of_many_pairs_at_once(monkeypatch):
    """All sizes about the ends of words, letters of several planes, edits on both sides of the threshold; also where tables of characters are split."""
    r = random.Random(31)
    pairs = []
    for _ in range(3000):
        letters = "abc é\U0001f600" if r.random() < 0.8 else [chr(0x4E00 + i) for i in range(900)]
        a = [r.choice(letters) for _ in range(r.choice([3, 10, 63, 64, 65, 127, 128, 130, 200, 400]))]
        b = a[:]
        for _ in range(r.randint(0, 1 + len(a) // 3)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "a", "éb"])
        pairs.append(("".join(a).encode(), "".join(b).encode()))
    found = _edit_distances_agree(pairs)
    assert 500 < found.sum() < 2500
    monkeypatch.setattr(fuzzy_lines, "TABLE", 1 << 14)
    monkeypatch.setattr(fuzzy_lines, "WIDE", 3)
    _edit_distances_agree(pairs)


@pytest.mark.parametrize(("often", "block"), [(64, 8192), (2, 8192), (2, 20)])
def test_all_similar_lines_under_a_key_are_linked(spark, monkeypatch, often, block):
    """Families of lines with scattered edits: every pair that shares a band and is similar ends in one group, however far its sketches are."""
    r = random.Random(32)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9)))
    lines = set()
    for _ in range(60):
        base = " ".join(word() for _ in range(r.choice([3, 5, 12, 25])))
        for _ in range(30):
            x = list(base)
            for i in r.sample(range(len(x)), max(1, int(len(x) * r.uniform(0.02, 0.16)))):
                x[i] = r.choice("etaoinshrdlu")
            lines.add(fuzzy_lines.normalised("".join(x).encode()))
    lines = sorted(lines)
    keys = defaultdict(list)
    for b in fuzzy_lines._keys_of(lines, np.arange(len(lines))):
        for key, h in zip(b.column("key").to_pylist(), b.column("h").to_pylist(), strict=True):
            keys[key].append(h)
    near = {p for own in keys.values() for p in itertools.combinations(sorted(own), 2)}
    near = [p for p in near if fuzzy_lines.similar(lines[p[0]], lines[p[1]])]
    monkeypatch.setattr(fuzzy_lines, "OFTEN", often)
    docs = table(spark, [(i, "\n".join(x.decode() for x in lines[i::20])) for i in range(20)])
    root = {int(g.h): g.root for g in fuzzy_lines.groups(docs, grams=True, block=block).collect()}
    own = [root[h] for h in fuzzy_lines._ids(lines)[0].tolist()]
    lost = [p for p in near if own[p[0]] is None or own[p[0]] != own[p[1]]]
    assert len(near) > 1000 and not lost, (len(lost), len(near))
    linked = set(near)
    reached = reach(len(lines), lambda i, j: (j, i) in linked)
    alone = [i if g is None else g for i, g in enumerate(own)]
    assert len(set(alone)) == len(set(reached))


def test_unlike_lines_are_told_apart_without_distances(monkeypatch):
    """op9_fuzzy_lines: of unlike lines of the same syllables few take an edit distance, and none that is similar is lost."""
    r = random.Random(51)
    pieces = "the of and to in is that er ed ing tion ent sh th wh ou ly es re on an at en nd st ha he or nt hi as it ble".split()
    line = lambda n: "".join(r.choice(pieces) + r.choice(["", "", " "]) for _ in range(n))
    unlike = [(line(n), line(n + r.randint(0, n // 8))) for n in (30, 60, 120, 250) for _ in range(100)]
    near = []
    for a, _ in unlike:  # edits in one place, moved pieces and scattered edits, on both sides of the threshold
        b, k = list(a), r.randint(1, len(a) // 4)
        kind, at = r.randrange(4), r.randrange(len(b) - k)
        if kind == 0:
            del b[at : at + k]
        elif kind == 1:
            b[at:at] = line(k)[:k]
        elif kind == 2:
            b = b[k // 2 :] + b[: k // 2]
        else:
            for i in r.sample(range(len(b)), k):
                b[i] = r.choice(["", "x", "\u00e9", b[i] + "y"])
        near.append((a, "".join(b)))
    both = [(a.encode(), b.encode()) for a, b in unlike + near]
    exact = [fuzzy_lines.edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in unlike + near]
    assert 100 < sum(exact) < 400
    for looked in (fuzzy_lines.LOOKED, 700):
        monkeypatch.setattr(fuzzy_lines, "LOOKED", looked)
        assert _edit_distances_agree(both).tolist() == exact
    compared, within = [], fuzzy_lines._within
    monkeypatch.setattr(fuzzy_lines, "_within", lambda pairs: (compared.extend(pairs), within(pairs))[1])
    monkeypatch.setattr(fuzzy_lines, "edit_distance", lambda *p, f=fuzzy_lines.edit_distance: (compared.append(p), f(*p))[1])
    fuzzy_lines.all_similar(*zip(*both[: len(unlike)], strict=True))
    assert len(compared) < len(unlike) / 4, len(compared)


def test_keys_of_few_lines_are_compared_together(monkeypatch):
    """op9_fuzzy_lines: pairs of many small keys go to one comparison."""
    lines = [b"%d the same line of several words, but for the end %d" % (i // 20, i % 20) for i in range(800)]
    h = np.arange(800)
    rows = pa.RecordBatch.from_arrays([pa.array(h // 20), pa.array(np.zeros(800, np.int32)), pa.array(h), pa.array(h), pa.nulls(800, pa.int32()), pa.array(np.full(800, 100)), pa.array([[int(k)] for k in h // 20], pa.list_(pa.int64())), pa.array(lines, pa.binary())], names=["key", "band", "h", "label", "side", "fp", "keys", "norm"])
    calls, compare = [], fuzzy_lines.all_similar
    monkeypatch.setattr(fuzzy_lines, "all_similar", lambda x, y, least: (calls.append(len(x)), compare(x, y, least))[1])
    found = {p for b in fuzzy_lines._compare(0.8)(iter([rows])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {(i, j) for i in range(800) for j in range(i + 1, i // 20 * 20 + 20)}
    assert sum(calls) == 40 * 190 and len(calls) <= 2


def test_packed_keys_are_all_keys():
    """What Spark moves holds each key of each line once, a bucket's in one row, in far fewer rows."""
    r = random.Random(33)
    lines = sorted({fuzzy_lines.normalised(" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 20))).encode()) for _ in range(3000)})
    keyed = fuzzy_lines._keys_of(lines, fuzzy_lines._ids(lines)[0])
    expected = sorted(row for b in keyed for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"\n".join(lines * 2)])], names=["doc_id", "text"])
    packed = [(k, np.frombuffer(x, np.int64).reshape(-1, 3)) for b in fuzzy_lines._gram_keys(iter([text])) for k, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(tuple(row) for _, x in packed for row in x.tolist()) == expected
    assert len(packed) == len({k for k, _ in packed}) <= fuzzy_lines.BUCKETS < len(expected) / 10
    assert all((x[:, 0] % fuzzy_lines.BUCKETS == k).all() for k, x in packed)


def test_bitmap_is_read_before_its_shuffle_goes(spark, tmp_path, monkeypatch):
    """op9_fuzzy_lines: the nodes are worked out once, however slowly rows are fetched: their shuffle files are deleted when the query ends, not before."""

    def seen(parts):
        (tmp_path / hashlib.sha1(os.urandom(16)).hexdigest()).touch()
        yield from parts

    def slowly(self, *a, read=type(spark.range(0)).toLocalIterator, **more):
        rows = read(self, *a, **more)
        time.sleep(2)
        return rows

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", slowly)
    hashes = [xxhash.xxh3_64_intdigest(b"%d" % i) - (1 << 63) for i in range(3000)]
    nodes = spark.createDataFrame([(h,) for h in hashes], "node long").repartition(3).mapInArrow(seen, "node long")
    with fuzzy_lines._cleanup(spark):
        found = np.frombuffer(fuzzy_lines._bitmap(nodes), np.uint8)
        nothing = fuzzy_lines._bitmap(spark.range(0).withColumnRenamed("id", "node"))
    on = np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist()
    assert on == sorted({h % (fuzzy_lines.SLOTS << 6) for h in hashes})
    assert not any(nothing) and len(list(tmp_path.iterdir())) == 3


def test_unlike_long_lines_rarely_share_a_band():
    """Few lines of the same sixty words share a band by chance; most lines with 5 % of their letters changed still do."""
    r = random.Random(41)
    pieces = "the of and to in is that er ed ing tion ent sh th wh ou ly es re on an at en nd st ha he or nt hi as it ble".split()
    words = sorted({r.choice(pieces) + r.choice(["", *pieces]) for _ in range(60)})
    lines = [" ".join(r.choice(words) for _ in range(130)).encode() for _ in range(2000)]
    edited = []
    for x in lines[:400]:
        y = list(x.decode())
        for i in r.sample(range(len(y)), len(y) // 20):
            y[i] = r.choice("etaoinshrdlu")
        edited.append("".join(y).encode())
    keys = defaultdict(set)
    for b in fuzzy_lines._keys_of(lines + edited, np.arange(len(lines) + len(edited))):
        for key, h in zip(b.column("key").to_pylist(), b.column("h").to_pylist(), strict=True):
            keys[key].add(h)
    near = {p for own in keys.values() for p in itertools.combinations(sorted(own), 2)}
    found = sum((i, len(lines) + i) in near for i in range(len(edited)))
    unlike = sum(j - len(lines) != i for i, j in near)
    assert found > 0.8 * len(edited) and unlike < 20_000, (found, unlike)


def test_recall_of_a_tables_similar_lines(spark):
    """Of the pairs of distinct lines of sf0.001 that brute force calls similar, nearly all end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted({n for d in docs.collect() for x in (d.text or "").encode().split(b"\n") if (n := fuzzy_lines.normalised(x))}, key=len)
    size = np.array([len(x.decode()) for x in lines])
    bags = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in lines], np.int32)
    pairs = []
    for i, x in enumerate(lines):
        far = np.abs(bags[i + 1 :] - bags[i]).sum(axis=1)  # an edit changes at most four bytes for four
        near = np.flatnonzero((far <= (8 if not x.isascii() else 2) * (0.2 * size[i + 1 :] + 1e-9)) & (size[i + 1 :] * 0.8 <= size[i])) + i + 1
        pairs += [(x, lines[j]) for j in near if fuzzy_lines.similar(x, lines[j])]
    root = {int(g.h): g.root for g in fuzzy_lines.groups(docs, grams=True).collect()}
    group = lambda x: root[int(fuzzy_lines._ids([x])[0][0])]
    found = sum(group(x) is not None and group(x) == group(y) for x, y in pairs)
    assert len(pairs) > 10 and found >= 0.9 * len(pairs), (found, len(pairs))


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = before = p.common.documents(spark, sf)
    for name, stage in p.STAGES:
        docs = p.common.stored(stage(spark, before, sf))
        if name != "best_fit_packing":
            assert docs.columns == list(p.COLUMNS) and docs.dtypes == before.dtypes
        if name in ("quality_crf", "exact_dedup", "simhash_near_dedup"):
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0 < docs.count() <= before.count()
        if name == "exact_dedup":
            assert docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("k")).distinct().count() == docs.count()
        if name == "simhash_near_dedup":
            assert p.simhash_dedup.near_duplicates(docs).where("doc_id <> component_id").count() == 0
        if name == "source_mixing":
            assert docs.where("n_chars <> char_length(text)").count() == 0
            total = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
            assert total(docs) == pytest.approx(1.5 * total(before), rel=0.05)
        before = docs
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert p.run(spark, sf).count() == before.count()


def brute_mix(spark, rows):
    """(doc_id, text) of the mix of one shard, word by word: blocks of 64 words, quotas quotient by quotient, a seeded run."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    hashed = spark.createDataFrame([(i, xxhash.xxh3_64_intdigest((t or "").encode()) >> 1) for i, t, _ in rows], "doc_id long, hash long")
    place = {x.doc_id: (x.place, x.hash) for x in hashed.withColumn("place", F.xxhash64(F.lit(0), "doc_id", "hash")).collect()}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted((i for i, _, x in rows if x == s), key=place.get) for s in sources}
    line = {s: [(i, k) for i in own[s] for k in range(len(words[i]))] for s in sources}
    target = mixing.targets({s: len(line[s]) for s in sources})
    blocks = {s: -(-len(line[s]) // 64) for s in sources}
    most = {s: min(math.ceil(2 * len(line[s]) / 64), 2 * blocks[s]) for s in sources}
    quota = dict.fromkeys(sources, 0)
    for _ in range(round(sum(target.values()) / 64)):
        free = [s for s in sources if quota[s] < most[s] and target[s] > 0]
        if not free:
            break
        quota[max(free, key=lambda s: (target[s] / (2 * quota[s] + 1), -sources.index(s)))] += 1
    out = Counter()
    for s in sources:
        if not quota[s]:
            continue
        full, rest = divmod(quota[s], blocks[s])
        start = xxhash.xxh3_64_intdigest(f"0:{s}:{place[own[s][0]][0]}".encode()) % blocks[s]
        epochs = [range(len(line[s]))] * full
        if rest:
            epochs.append([w for b in range(start, start + rest) for w in range(b % blocks[s] * 64, min((b % blocks[s] + 1) * 64, len(line[s])))])
        for epoch in epochs:
            taken = defaultdict(list)
            for w in sorted(set(epoch)):
                taken[line[s][w][0]].append(line[s][w][1])
            for i, ks in taken.items():
                out[i, tuple(words[i][k] for k in ks)] += 1
    return out


def test_each_stage_of_the_pipeline_equals_brute_force(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = p.common.documents(spark, sf)
    rows = [tuple(d) for d in docs.collect()]
    stages, now = dict(p.STAGES), docs

    def run(name):
        nonlocal now
        now = p.common.stored(stages[name](spark, now, sf))
        return [tuple(d) for d in now.collect()]

    model = quality_crf.train(docs, p.common.documents(spark, sf, "labels"))
    good = [d for d in rows if quality_crf.scores(model, *zip(quality_crf.line_features((d[1] or "").encode()), strict=True))[0] >= 0.3]
    assert sorted(run("quality_crf")) == sorted(good) and 0 < len(good) < len(rows)

    groups = defaultdict(list)
    for d in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")].append(d)
    unique = [min(g, key=lambda d: (-len(d[1] or ""), d[0], d[1])) for g in groups.values()]
    assert sorted(run("exact_dedup")) == sorted(unique) and len(unique) < len(good)

    fp = [brute_fingerprint(d[1]) for d in unique]
    root = reach(len(unique), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    least = defaultdict(lambda: math.inf)
    for d, r in zip(unique, root, strict=True):
        least[r] = min(least[r], d[0])
    apart = [d for d, r in zip(unique, root, strict=True) if d[0] == least[r]]
    assert sorted(run("simhash_near_dedup")) == sorted(apart)

    mixed = run("source_mixing")
    assert Counter((d[0], tuple(re.findall(r"[^\x20\x09-\x0D]+", d[1]))) for d in mixed) == brute_mix(spark, [(d[0], d[1], d[3]) for d in apart])
    by_id = {d[0]: d for d in apart}
    assert all(d[2:4] == by_id[d[0]][2:4] and d[4] == len(d[1]) for d in mixed)

    t, expected = Tokenizer.from_file(tokenizer_path()), Counter()
    for d in mixed:
        ids = np.array([*t.encode(d[1], add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d[0], n, i, j - i, zlib.crc32(ids[i:j].tobytes())] += 1
    packed = run("best_fit_packing")
    assert Counter(x[:5] for x in packed) == expected
    ends = defaultdict(int)
    for x in sorted(packed, key=lambda x: x[5:]):
        assert x[6] == ends[x[5]]
        ends[x[5]] += x[3]
    assert max(ends.values()) <= 2048 and len(ends) <= max(-(-sum(ends.values()) // 2048), sum(2 * x[3] > 2048 for x in packed)) * 11 / 9 + 1


def test_registered_queries_run(spark):
    from lumatile.llm.queries import ORACLE_SQL, QUERIES

    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert json.dumps(sorted(QUERIES["op5_source_mixing"](spark, "/root/testdata/sf0.001").columns)) == json.dumps(["doc_id", "size", "source", "source_size", "taken", "target"])
