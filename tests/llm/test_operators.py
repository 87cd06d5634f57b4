import collections
import hashlib
import itertools
import math
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus  # noqa: E402

from cadastra.llm import exact_dedup, fingerprints, jaccard_join, language_id, lattice, lm_scoring, mixing, quality, sentencepiece_sampling, suffix_dedup, url_filter  # noqa: E402

WHITE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).cache()


def counted(rows):
    return collections.Counter(map(tuple, rows))


# 8: exact dedup


def test_exact_dedup_against_brute_force(spark, docs):
    groups = collections.defaultdict(list)
    for r in corpus.rows():
        groups[WHITE.sub("", r[1] or "")].append((-(len(r[1]) if r[1] else 0), r[0] is None, r[0] or 0, r[0]))
    want = []
    for text, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            want.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, capacity=8).collect()
    assert counted(got) == counted(want)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == corpus.COLUMNS and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(corpus.empty(spark)).count() == 0 == exact_dedup.drop_copies(corpus.empty(spark)).count()


def test_directory_splits_overfull_buckets():
    counts = {0: 5, 1: 1, 2: 1, 7: 9}
    found = exact_dedup.split_directory(counts, capacity=6, bits=3)
    assert sum(w for _, w in found) == 8
    for first, width in found:
        held = sum(n for p, n in counts.items() if first <= p < first + width)
        assert held <= 6 or width == 1
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 500).astype(np.uint64))  # all under one pointer
    depth = exact_dedup.split_keys(keys, 10, 16)
    held = collections.Counter(format(k, "064b")[:d] for k, d in zip(keys.tolist(), depth.tolist()))
    assert max(held.values()) <= 10 and len(held) > 40 and sum(held.values()) == 500
    assert not any(a != b and b.startswith(a) for a in held for b in held)


def test_chains_compare_bytes():
    """Two texts under one key stay two entries."""
    rows = [(7, "b", 5, 1), (7, "a", 4, 1), (3, "x", 9, 2), (7, "b", 6, 3), (7, "a", None, 1), (8, "b", 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[0] * 6, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [1] * 6], [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()])], ["owner", "key", "norm", "keep_id", "best_chars", "group_size"])
    got, chain = exact_dedup._chained(batch)
    assert [(r["key"], c, r["norm"], r["keep_id"], r["best_chars"], r["group_size"]) for r, c in zip(got.to_pylist(), chain.tolist())] == [(3, 0, "x", 9, 2, 1), (7, 0, "b", 6, 3, 2), (7, 1, "a", 4, 1, 2), (8, 0, "b", 1, 1, 1)]


def test_index_holds_every_text_once(spark, docs):
    _, entries = exact_dedup.build_index(docs, capacity=4)
    rows = entries.collect()
    texts = {WHITE.sub("", r[1] or "") for r in corpus.rows()}
    assert {r["sha"] for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in texts} and len(rows) == len(texts)
    buckets = collections.Counter(r["bucket"] for r in rows)
    assert max(buckets.values()) <= 4 and len(buckets) > 5
    for r in rows:
        assert len(r["bucket"]) == r["depth"] and format(r["key"] % (1 << 64), "064b").startswith(r["bucket"])


# 9: URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.org/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://xorg/", "xorg", "/", None, "allow"),
        ("http://org/", "org", "/", "org/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://b.com/fr/casino-bet", "b.com", "/fr/casino-bet", "com/fr/", "allow"),
        ("http://b.net/casino-bet", "b.net", "/casino-bet", None, "block"),
        ("http://b.net/casino-casino", "b.net", "/casino-casino", None, "allow"),
        ("http://b.net/casinobet", "b.net", "/casinobet", None, "allow"),
        ("http://xxx.net?a://b", "xxx.net", "", None, "block"),
        ("no scheme/porn", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    got = url_filter.filter_urls(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")).first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_no_urls(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 6: mixing


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    left = set(order)
    while left:
        rest, w = total - sum(done.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            return done | {s: rest * weight[s] / w for s in left}
        done |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return done


def test_mix(spark, docs):
    sizes = collections.Counter()
    for r in corpus.rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = water(sizes)
    got = mixing.mix(docs).join(docs.select(F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("row_id"), "source").distinct(), "row_id").collect()
    assert len(got) == len(corpus.rows())
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(6, 0.02 * t), (s, taken[s], t)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rows: counted((r["row_id"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    rows = mixing.mixed(docs)
    assert rows.columns == corpus.COLUMNS
    assert rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix(corpus.empty(spark)).count() == 0 == mixing.mixed(corpus.empty(spark)).count()


def test_sources_without_words_and_many_sources(spark):
    rows = [(i, None if i % 2 else " \t", "empty") for i in range(6)] + [(10 + i, "a b c d", "one") for i in range(9)]
    rows += [(100 + i, "x " * (1 + i % 7), f"host{i % 40:02d}") for i in range(200)] + [(900, "y y", None)]
    for some in (rows, rows[:6], rows[6:15]):
        sizes = collections.Counter()
        for _, text, source in some:
            sizes[source] += len((text or "").split())
        want = water(sizes)
        docs = spark.createDataFrame(some, "doc_id long, text string, source string")
        taken, source = collections.Counter(), {r[0]: r[2] for r in some}
        for r in mixing.mix(docs).collect():
            taken[source[r["doc_id"]]] += r["taken"]
            assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert all(abs(taken[s] - t) <= max(6, 0.02 * t) for s, t in want.items())
        assert mixing.mixed(docs).columns == docs.columns


# 7: fingerprints


def slow_syncmers(raw, k, s):
    value = lambda part: int(fingerprints.Rolling(np.frombuffer(part, np.uint8)).every(len(part))[0])
    found = []
    for i in range(len(raw) - k + 1):
        inner = [value(raw[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_syncmers_against_brute_force():
    raw = b"the people would and could under water und der mit einer menschen"
    row, at, _ = fingerprints.syncmers(np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)]))
    want = slow_syncmers(raw, fingerprints.K, fingerprints.S)
    assert at[row == 0].tolist() == want and (at[row == 1] - len(raw)).tolist() == want


def test_anchors_are_matched_by_position():
    rng = np.random.default_rng(6)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage, a, b = text(3000), text(1000), text(1000)
    sketch = lambda *ts: fingerprints.sketches(*fingerprints.text_bytes(pa.array(ts)))
    like = lambda x, y: float(fingerprints.likeness(sketch(x), sketch(y))[0])
    assert like(passage, passage) == 1 and like("", "") == 1 and like("", passage) == 0 and like("short", "short") == 1
    assert like(a + passage, passage + b) > 0.4  # moved, as a whole
    # Common anchors whose places fit no other's don't count.
    one = sketch(passage)
    spread = one.copy()
    spread[:, :, 1] = np.arange(fingerprints.BINS) * 10_000 + 5
    assert fingerprints.likeness(one, spread)[0] == 0 and fingerprints.likeness(one, one + [0, 700])[0] == 1
    assert len(fingerprints.as_text(one)[0]) == 12 * fingerprints.BINS and fingerprints.as_text(sketch(""))[0] == "-" * 12 * fingerprints.BINS


def test_fingerprints(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    texts = {r[0]: r[1] or "" for r in one.select("doc_id", "text").collect()}
    order = sorted(texts, key=lambda i: (i is None, -(i or 0)))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(one).collect()}
    assert len(got) == len(texts)
    by_text = {}
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1
    assert fingerprints.fingerprint_edits(docs).count() == len(corpus.rows())
    assert fingerprints.fingerprint_edits(corpus.empty(spark)).count() == 0
    assert fingerprints.anchors(docs).filter("doc_id = 8").count() > 100
    alone = fingerprints.fingerprint_edits(docs.filter("doc_id = 8")).first()
    assert alone["near_next"] == 1


# 1: language


def ways_of(word, ids, unknown):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        i = ids.get(word[:n], unknown if n == 1 else None)
        if i is not None:
            for rest in ways_of(word[n:], ids, unknown):
                yield (i, *rest)


def test_forward_and_counts_against_all_segmentations():
    known = lattice.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a"])
    p = np.array([[0.2, 0.1], [0.1, 0.3], [0.15, 0.1], [0.05, 0.2], [0.3, 0.1], [0.1, 0.1], [0.1, 0.1], [1e-4, 1e-4]])
    for words in (["▁ababa", "▁xab", "▁", "▁bbaab"], ["▁ababa", "▁xab" + "x" * 32, "▁", "▁bbaab"]):  # with a long one, in logarithms
        lat = lattice.build(words, known)
        alpha, beta = lattice.forward(lat, np.log(p)), lattice.backward(lat, np.log(p))
        used = np.zeros(8)
        for w, word in enumerate(words):
            every = [(s, np.prod(p[list(s)], axis=0)) for s in ways_of(word, known.ids, 7)]
            total = sum(x for _, x in every)
            assert np.allclose(alpha[lat.last[w]], np.log(total)) and np.allclose(beta[lat.node[w]], np.log(total))
            for s, x in every:
                for i in s:
                    used[i] += (w + 1) * x[0] / total[0]
        assert np.allclose(lattice.expected_counts(lat, np.log(p[:, :1]), np.arange(1, 5)), used)


def test_long_runs_are_whole():
    """Runs of letters beyond any table: a recursion over their places gives the sum over all segmentations."""
    pieces = language_id.load_pieces()
    known = lattice.Pieces(pieces)
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2)) / len(pieces)
    words = ["donaudampfschifffahrtselektrizitätenhauptbetriebswerk", "自然语言处理是计算机科学领域与人工智能领域中的一个重要方向它研究能实现人与计算机之间用自然语言进行有效通信的各种理论", "ab" * 400, "und"]
    for word, got in zip(words, language_id._log_p(words, known, np.log(p)), strict=True):
        text = lattice.SPACE + word
        total = np.full((len(text) + 1, 2), -np.inf)
        total[0] = 0
        for e in range(1, len(text) + 1):
            for a in range(max(0, e - 16), e):
                i = known.ids.get(text[a:e], len(pieces) if e - a == 1 else None)
                if i is not None:
                    total[e] = np.logaddexp(total[e], total[a] + np.log(p[i]))
        assert np.allclose(got, total[-1])
    assert language_id.words_of("Donaudampfschifffahrtselektrizitätenhauptbetriebswerk!") == words[:1]


def test_language(spark, docs):
    got = language_id.identify_held_out(docs).collect()
    lang = {r[0]: r[2] for r in corpus.rows()}
    text = {r[0]: r[1] for r in corpus.rows()}
    assert len(got) == len(corpus.rows())
    for r in got:
        if r["doc_id"] is None:
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert letters or (r["lang_pred"] == "und" and r["score"] == 0)
        if letters and lang[r["doc_id"]] and r["doc_id"] not in (20, 21, 22, 34, 35):
            assert r["lang_pred"] == lang[r["doc_id"]]
        assert 0 <= r["score"] <= 1
    kept = language_id.keep_identified(docs)
    assert kept.columns == corpus.COLUMNS
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(30)}
    assert not {30, 31, 32, 33} & {r["doc_id"] for r in kept.collect()}
    odd = spark.createDataFrame([(900, "xqzv kjhw plmnq wrtzx vbnmk qqxj zzkw"), (901, "zażółć gęślą jaźń, proszę państwa bardzo dziękuję wszystkim"), (902, "the")], "doc_id long, text string")
    mixed = docs.unionByName(odd, allowMissingColumns=True)
    assert {r["doc_id"] for r in language_id.keep_identified(mixed).filter("doc_id >= 900").collect()} == {902}
    assert language_id.identify_held_out(corpus.empty(spark)).count() == 0 == language_id.keep_identified(corpus.empty(spark)).count()
    assert {r["lang_pred"] for r in language_id.identify_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 2: Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return counted((r[0], least.get(find(i)) if sets[i] else r[0], links[i]) for i, r in enumerate(rows))


def test_jaccard_against_brute_force(spark, docs):
    got = jaccard_join.jaccard_classes(docs).select("doc_id", "class_id", "n_links").collect()
    assert counted(got) == slow_classes(corpus.rows())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == corpus.COLUMNS
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 in ids and 8 in ids and not {5, 6, 9, 10} & set(ids) and {30, 31, 32, 33} <= set(ids)
    assert jaccard_join.jaccard_classes(corpus.empty(spark)).count() == 0 == jaccard_join.keep_one(corpus.empty(spark)).count()


def test_jaccard_with_large_groups(spark):
    """A large group of near copies, in several blocks, and a passage that most texts share."""
    base = [f"w{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        words[i % 119] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"u{i}x{j}" for j in range(60)] + passage)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_classes(docs, limit=8, block=16).select("doc_id", "class_id", "n_links").collect()
    assert counted(got) == slow_classes(rows)


def test_jaccard_balls(spark):
    """Groups of long near copies, which lie in balls, others at the limit of similarity, and two groups that are near each other."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(400, 1 if i < 70 else int(rng.integers(2, 9)), replace=False):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    other = [*base[:360], *[f"o{i}" for i in range(40)]]
    for i in range(60):
        words = list(other)
        words[int(rng.integers(0, 400))] = f"else{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, rows[0][1]), (301, rows[130][1]), (302, rows[130][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    node_ball = []
    made = jaccard_join.balls

    def seen(*args):
        node_ball.append(made(*args))
        return node_ball[-1]

    jaccard_join.balls = seen
    try:
        got = jaccard_join.jaccard_classes(docs, limit=8, block=16).select("doc_id", "class_id", "n_links").collect()
    finally:
        jaccard_join.balls = made
    assert counted(got) == slow_classes(rows)
    assert node_ball[0].count() > 100


@pytest.mark.parametrize("block, limit", [(8, 8), (24, 256), (24, 8), (1024, 256)])
def test_jaccard_balls_that_meet_in_small_homes_too(spark, block, limit):
    """20 near copies of two parts meet with many by the first part, and with a smaller one alone by the second."""
    first, second = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(200)]
    rows = [(10 + i, " ".join([*first, *second, f"end{i}"])) for i in range(20)]
    rows += [(100 + i, " ".join([*first, *[f"c{i}x{j}" for j in range(200)]])) for i in range(40)]
    rows.append((1, " ".join(second)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_classes(docs, limit=limit, block=block).select("doc_id", "class_id", "n_links").collect()
    assert counted(got) == slow_classes(rows)


# 4: suffixes


def slow_repeats(rows):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        raw = (r[1] or "").encode()
        for w in {raw[i : i + 50] for i in range(len(raw) - 49)}:
            seen.setdefault(w, r[0] if r[0] is not None else math.inf)
    for r in order:
        raw, own = (r[1] or "").encode(), r[0] if r[0] is not None else math.inf
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < own:
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return counted(out)


def test_repeats_against_brute_force(spark, docs):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert counted(got) == slow_repeats(corpus.rows())
    kept = suffix_dedup.remove_repeats(docs, with_text=True).filter("doc_id = 21").first()
    assert kept["spans"] and hashlib.sha256(kept["kept"].encode()).hexdigest() == kept["kept_sha256"]
    assert suffix_dedup.remove_repeats(corpus.empty(spark)).count() == 0


def test_repeats_in_many_pieces_and_hot_anchors(spark):
    """Small pieces, an anchor that is hot in some of them only, copies over pieces, tied ids and NUL bytes."""
    rng = np.random.default_rng(5)
    words = "the and of that with this from there which about people would could water under".split()
    text = lambda n: " ".join(rng.choice(words, n))
    passage = "this very passage is shared by very many of the documents here, and it is longer than fifty"
    rows = [(int(i), f"{text(12)} {passage}{i * 7919 % 1000} {text(9)}") for i in rng.permutation(300)]
    rows += [(1000 + i, text(60)) for i in range(60)] + [(i, rows[i][1] + text(30)) for i in range(5)]
    rows += [(4000 + i, f"{text(3)} {'xyz' * (40 + i)} {'-' * (200 - i)} {text(5)} {'-' * (70 + i)}") for i in range(6)]
    rows += [(2000 + i, "a" * 200 + "\0" * (60 + i) + passage) for i in range(4)] + [(None, passage), (None, passage), (3000, passage * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tasks, piece, hot in ((1, 1 << 20, 8), (5, 4000, 3), (2, 3000, 1), (3, 1 << 20, 10**6)):
        assert counted(suffix_dedup.remove_repeats(docs.repartition(tasks), piece_bytes=piece, hot=hot).collect()) == slow_repeats(rows)


def test_one_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 3 << 20).astype(np.uint8).tobytes().decode()
    rows = [(1, long[: 1 << 20]), (2, long), (3, long[2000:])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), piece_bytes=1 << 20).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 1 << 20, len(long) - 2000] and [got[i]["n_spans"] for i in (1, 2, 3)] == [0, 1, 1]
    assert got[2]["kept_sha256"] == hashlib.sha256(long[1 << 20 :].encode()).hexdigest()


def test_levels_merge_geometrically():
    gone: list = []
    index, rng = suffix_dedup.LogIndex(lambda s: gone.extend(zip(s.row.tolist(), s.id.tolist(), strict=True))), np.random.default_rng(0)
    seen = collections.defaultdict(list)
    for batch in rng.permutation(40).tolist():
        keys = rng.integers(0, 3000, 100)
        rows = np.arange(100) + 100 * batch
        raw = np.array([b"%078d" % k for k in keys.tolist()], f"S{suffix_dedup.WIDTH}")
        index.add(suffix_dedup.Suffixes(raw, np.full(100, batch), np.zeros(100, np.int64), rows.astype(np.uint32), *np.zeros((2, 100), np.uint32)))
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            seen[k].append((batch, r))
        assert len(index.levels) <= 10
    assert {r for r, _ in gone} == {r for own in seen.values() for i, r in own if i > min(own)[0]}
    whole = index.whole()
    assert (whole.keys[1:] >= whole.keys[:-1]).all() and len(set(whole.keys.tolist())) == len(seen)


# 5: SentencePiece


def test_samples_are_distinct_and_lossless(spark, docs):
    got = sentencepiece_sampling.encode_samples(docs, k=3)
    rows = got.collect()
    assert all(r["lossless"] for r in rows) and all(0 < r["inclusion"] <= 1 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == {r[0] for r in corpus.rows()}
    for d, found in by.items():
        if d in (None, 12, 40):
            continue
        found.sort(key=lambda r: r["sample"])
        assert len({tuple(r["ids"]) for r in found}) == len(found)
        assert [r["perturbed"] for r in found] == sorted((r["perturbed"] for r in found), reverse=True)
    text = {r[0]: r[1] or "" for r in corpus.rows()}
    for r in got.select("doc_id", sentencepiece_sampling.decode(F.col("ids")).alias("t")).filter("doc_id is not null").collect():
        assert r["t"] == text[r["doc_id"]]
    again = sentencepiece_sampling.encode_samples(docs.repartition(7), k=3).collect()
    key = lambda rows: counted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in rows)
    assert key(rows) == key(again)
    assert sentencepiece_sampling.encode_samples(corpus.empty(spark)).count() == 0


def test_samples_follow_the_distribution():
    pieces, byte0 = sentencepiece_sampling.load_vocabulary()
    sampler = sentencepiece_sampling.Sampler(pieces, byte0)
    weight = lambda u: sampler.p[sampler.vocabulary.ids[u], 0] if u in sampler.vocabulary.ids else (1e-9 if len(u) == 1 else 0)

    def ways(word):
        if not word:
            yield (), 1.0
        for n in range(1, len(word) + 1):
            if w := weight(word[:n]):
                for rest, x in ways(word[n:]):
                    yield (word[:n], *rest), w * x

    text = "erana isti"
    every = {}
    for parts in itertools.product(*(list(ways(u)) for u in (" erana", " isti"))):
        every[sum((p for p, _ in parts), ())] = math.prod(x for _, x in parts)
    total = sum(every.values())
    every = {tuple(pieces.index(p) for p in s): x / total for s, x in every.items()}
    n, first, second = 6000, collections.Counter(), collections.Counter()
    seeds = sentencepiece_sampling.mix64(np.arange(n, dtype=np.uint64) + np.uint64(3))
    for rows in sampler.sample([text] * n, seeds, 2):
        a, b = (tuple(r[3].tolist()) for r in rows)
        first[a] += 1
        second[b] += 1
        assert abs(math.exp(rows[0][0]) - every[a]) < 1e-9
    for s, x in every.items():
        after = sum(y * x / (1 - y) for t, y in every.items() if t != s)
        assert abs(first[s] / n - x) < 4 * math.sqrt(x / n) + 1e-3
        assert abs(second[s] / n - after) < 4 * math.sqrt(after / n) + 1e-3


def test_units_lose_no_segmentation():
    """Runs of spaces and a run of 200 letters: sums over the units are those over the whole text, and samples are distinct and likely as they say."""
    pieces, byte0 = sentencepiece_sampling.load_vocabulary()
    sampler = sentencepiece_sampling.Sampler(pieces, byte0)
    ids = sampler.vocabulary.ids
    for text in ("    def  f(x):\n        return x", "wiederholung" * 17, "一二三天地人" * 30, "☃" * 50, "https://example.org/a/very/long/path?with=things&and=more", "", "x"):
        whole = " " + text
        total = np.full(len(whole) + 1, -np.inf)
        total[0] = 0
        for e in range(1, len(whole) + 1):
            for a in range(max(0, e - 16), e):
                i = ids.get(whole[a:e], len(ids) if e - a == 1 else None)
                if i is not None:
                    total[e] = np.logaddexp(total[e], total[a] + sampler.log_w[i, 0])
        found = sampler.sample([text] * 3, sentencepiece_sampling.mix64(np.arange(3, dtype=np.uint64)), 4)
        for rows in found:
            assert len({tuple(r[3].tolist()) for r in rows}) == len(rows)
            for log_p, _, inclusion, got in rows:
                assert sentencepiece_sampling.Decoder(pieces, byte0)(got).tobytes() == whole.encode() and 0 < inclusion <= 1
                parts, at = [], 0
                while at < len(got):
                    if byte0 <= got[at] < byte0 + 256:
                        lead = int(got[at] - byte0)
                        at += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                        parts.append(len(ids))
                    else:
                        parts.append(ids[pieces[got[at]]])
                        at += 1
                assert abs(sampler.log_w[parts, 0].sum() - total[-1] - log_p) < 1e-6 * max(1, abs(log_p))
        ways = [1] + [0] * len(whole)
        for e in range(1, len(whole) + 1):
            ways[e] = sum(ways[a] for a in range(max(0, e - 16), e) if whole[a:e] in ids or e - a == 1)
        assert {len(rows) for rows in found} == {min(4, ways[-1])}


def test_third_sample_follows_the_distribution():
    pieces, byte0 = sentencepiece_sampling.load_vocabulary()
    sampler = sentencepiece_sampling.Sampler(pieces, byte0)
    ids = sampler.vocabulary.ids
    every = {tuple(sampler.piece_id[list(s)].tolist()): math.prod(sampler.p[list(s), 0]) for s in ways_of(" eran", ids, None) if None not in s}
    total = sum(every.values())
    every = {s: x / total for s, x in every.items()}
    n, third = 6000, collections.Counter()
    for rows in sampler.sample(["eran"] * n, sentencepiece_sampling.mix64(np.arange(n, dtype=np.uint64) + np.uint64(9)), 3):
        third[tuple(rows[2][3].tolist())] += 1
    for s, x in every.items():
        after = sum(y * z / (1 - y) * x / (1 - y - z) for (t, y), (v, z) in itertools.permutations(every.items(), 2) if s not in (t, v))
        assert abs(third[s] / n - after) < 4 * math.sqrt(after / n) + 1e-3


# 3: LM scoring


def test_network_gradient():
    network = lm_scoring.Network()
    around, kind = np.array([[1, 5], [2, 128], [3, 7], [4, 9]]), np.array([10, 20])
    loss = lambda: -network.log_p(around, kind).mean()
    before = loss()
    for _ in range(20):
        network.learn(around, kind)
    assert loss() < before - 1


def test_scores(spark, docs):
    words = lm_scoring.count_words(docs)
    network = lm_scoring.train(docs, words, rounds=3, mask_every=2, batch=64)
    got = lm_scoring.score(docs, words, network).collect()
    assert len(got) == len(corpus.rows())
    text = {r[0]: r[1] for r in corpus.rows()}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")) if r["doc_id"] is not None else r["n_tokens"]
        assert r["n_tokens"] == n and (r["per_token"] is None) == (n == 0) and r["log_likelihood"] <= 0
    mean = lambda net: sum(r["log_likelihood"] for r in lm_scoring.score(docs, words, net).collect())
    assert mean(network) > mean(lm_scoring.Network())
    assert lm_scoring.train_and_score(corpus.empty(spark)).count() == 0


def test_scores_against_brute_force(spark, docs):
    """Each token's class down the tree, from its four neighbours, and its share of the class's count, in plain Python."""
    words = lm_scoring.count_words(docs, vocabulary=4)
    network = lm_scoring.train(docs, words, rounds=2, mask_every=2, batch=64)
    n = collections.Counter(w for r in corpus.rows() for w in re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()))
    name = {w: int(lm_scoring.tokens(pa.array([w]))[1][0]) for w in n}
    kind = dict(zip(n, words(np.array([name[w] for w in n], np.uint64))[0].tolist(), strict=True))
    whole = collections.Counter()
    for w, k in kind.items():
        whole[k] += n[w]

    def log_p(left2, left, right, right2, own):
        h = [math.tanh(float(network.shift[i]) + sum(float(network.places[j][c][i]) for j, c in enumerate((left2, left, right, right2)))) for i in range(lm_scoring.HIDDEN)]
        leaf, total = own + network.classes, 0.0
        for d in range(network.depth, 0, -1):
            node = leaf >> d
            x = sum(a * float(b) for a, b in zip(h, network.out[node], strict=True)) + float(network.bias[node])
            total -= math.log1p(math.exp(x if (leaf >> (d - 1)) & 1 else -x))
        return total

    got = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(docs, words, network).collect()}
    for r in corpus.rows()[:45]:
        line = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        at = lambda i: kind[line[i]] if 0 <= i < len(line) else network.classes  # noqa: E731, B023
        want = sum(log_p(at(i - 2), at(i - 1), at(i + 1), at(i + 2), kind[w]) + math.log(n[w] / (whole[kind[w]] + 1)) for i, w in enumerate(line))
        assert abs(got[r[0]] - want) < 1e-3 * max(1, abs(want)), (r[0], got[r[0]], want)


def test_rare_words_have_their_own_counts(spark):
    rows = [(i, " ".join(["often", "common", "usual"] * 3)) for i in range(20)] + [(100 + i, "mediocre") for i in range(30)] + [(200, "mediocre"), (201, "hapax")]
    rows += [(300 + i, f"w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = lm_scoring.count_words(docs, vocabulary=3)
    network = lm_scoring.Network(classes=len(words.whole))
    network.start(words.whole)
    network.out[:] = 0  # each class has its share of all tokens, so each word has its own share
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(docs, words, network).collect()}
    n = collections.Counter(w for _, t in rows for w in t.split())
    shared = [f"w{i}" for i in range(400) if got[300 + i] < -3]
    assert len(shared) > 300 and len(got) == len(rows)
    assert got[200] == got[100] and got[200] - got[201] > math.log(n["mediocre"]) - 1.5
    # Words beyond the classes of their own are told apart by their counts, whatever vocabulary is.
    other = spark.createDataFrame([(i, " ".join([f"v{i}"] * (1 + i))) for i in range(200)], "doc_id long, text string")
    few, all_ = (lm_scoring.count_words(other, vocabulary=v) for v in (1, 8192))
    net = lm_scoring.Network()
    a, b = ({r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(other, w, net).collect()} for w in (few, all_))
    assert all(abs(a[i] - b[i]) < 1e-6 * max(1, abs(b[i])) for i in range(200))


def test_classes_grow_and_sum_to_one():
    assert lm_scoring.classes_for(100) == 128 and lm_scoring.classes_for(10**6) == 2048 and lm_scoring.classes_for(10**8) > 16000
    network = lm_scoring.Network(classes=512)
    assert lm_scoring.Network(network.flat).classes == 512
    near = np.repeat(np.array([[1], [512], [3], [400]]), 512, 1)
    assert abs(np.exp(network.log_p(near, np.arange(512))).sum() - 1) < 1e-4


# 10: quality


def test_quality(spark, docs):
    junk = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat_ws("$$ ", F.lit("AAA"), F.col("text"), F.lit("!!! ### $$$ !!! ### $$$ !!!"))).otherwise(F.col("text")))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(junk, quality.train(junk, labels)).collect()
    assert len(got) == len(corpus.rows())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 30]
    assert np.mean(right) > 0.9
    assert quality.judge(corpus.empty(spark), quality.train(corpus.empty(spark), labels)).count() == 0
    assert {r["score"] for r in quality.judge(junk, quality.train(junk, labels.limit(0))).collect()} == {0.5}


def test_ties_all_vote():
    model = quality.fit(np.eye(6, quality.DIMS, dtype=np.float32), np.array([1, 1, 0, 1, 0, 0], float), latent=4)
    model.vectors[:] = model.vectors[0]  # all alike: with k = 1 all six vote
    assert abs(quality.vote(model, np.eye(1, quality.DIMS, dtype=np.float32), k=1)[0] - 0.5) < 1e-6


def test_very_long_texts(spark):
    """One text of 3 MB, beyond the size of what is worked on at a time, goes through every operator whole."""
    rng = np.random.default_rng(3)
    words = np.array("the and of that with this from there which about people would could water under".split())
    long = " ".join(rng.choice(words, 600_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "b", len(long) + 4), (3, "der und nicht mit einer auch werden durch", "de", "a", 40), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long) > 3 << 20
    by = lambda frame: {r["doc_id"]: r for r in frame.collect()}
    assert by(language_id.identify_held_out(docs))[1]["n_words"] == 600_000
    assert by(jaccard_join.jaccard_classes(docs))[2]["class_id"] == 1
    assert by(suffix_dedup.remove_repeats(docs))[2]["n_removed"] >= len(long)
    assert by(mixing.mix(docs))[1]["size"] == 600_000
    assert by(fingerprints.fingerprint_edits(docs))[1]["n_chars"] == len(long)
    assert by(exact_dedup.exact_dedup(docs))[1]["text_sha256"] == hashlib.sha256(long.replace(" ", "").encode()).hexdigest()
    samples = sentencepiece_sampling.encode_samples(docs).filter("doc_id = 1").collect()
    assert len(samples) == 2 and all(r["lossless"] for r in samples)
    counted_words = lm_scoring.count_words(docs)
    assert by(lm_scoring.score(docs, counted_words, lm_scoring.Network(classes=len(counted_words.whole))))[1]["n_tokens"] == 600_000


def test_vote_is_exact():
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((50, quality.DIMS))).astype(np.float32)
    model = quality.fit(x, (np.arange(50) % 2).astype(float), latent=8)
    z = quality._weighted(x, model.weight) @ model.axes
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i, s in enumerate(quality.vote(model, x, k=5)):
        near = z[i] @ model.vectors.T
        top = np.argsort(-near)[:5]
        w = np.maximum(near[top], 1e-6) ** 20
        assert abs(s - (w * model.quality[top]).sum() / w.sum()) < 1e-3
