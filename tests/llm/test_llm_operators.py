"""Every training-data operator against brute force, on the driver tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import canonical_rows, compare, connect
from fleetlens.llm import chat, decontamination, exact_dedup, near_dedup, packing, quality, queries, sharding, substring_dedup, token_counts, url_filters
from fleetlens.llm.common import same_words, stored, word_codes
from fleetlens.llm.tokens import ByteCounts, WordIds, encoder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE, WORD_BPE = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def pairs(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, note


# 1 sharding


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_sharding(request, source):
    frame = request.getfixturevalue(source)
    rows = sharding.shard_documents(frame, sharding.even_tree(16), sharding.grown_tree(sharding.even_tree(16))).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in pairs(frame))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_takes_keys_only_into_itself(spark):
    ids = spark.range(2_000).select(F.col("id").alias("doc_id"))
    trees = [(sharding.even_tree(n), n) for n in (1, 2, 3, 5, 8, 9, 12, 16, 17, 40)] + [(sharding.grown_tree(sharding.even_tree(16), n), 16 + n) for n in (1, 2, 9)]
    for i, (tree, n) in enumerate(trees):
        both = sharding.place(sharding.place(ids, "doc_id", tree), "doc_id", sharding.grown_tree(tree), "grown_").collect()
        assert all(r["grown_shard"] in (r["shard"], n) for r in both) and any(r["grown_shard"] == n for r in both), (i, n)


def test_weights_move_keys_only_in_changed_subtrees(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    tree = sharding.even_tree(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    moved = sharding.place(sharding.place(ids, "doc_id", tree), "doc_id", heavier, "new_").filter("shard <> new_shard")
    # a region or rack that shard 5 is not in loses keys to the grown one and gains none
    assert moved.filter("region <> new_region and new_region <> 0").count() == 0
    assert moved.filter("region = new_region and rack <> new_rack and new_rack <> 1").count() == 0
    assert moved.filter("rack = new_rack and new_shard <> 5").count() == 0
    share = sharding.place(ids, "doc_id", heavier).groupBy("shard").count().collect()
    assert all(abs(r["count"] / 20_000 - (2 if r["shard"] == 5 else 1) / 17) < 0.01 for r in share)
    closed = [sharding.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 3 else 1.0) for x in tree]
    assert sharding.place(ids, "doc_id", closed).filter("shard = 3").count() == 0
    with pytest.raises(ValueError):
        sharding.place(ids, "doc_id", [sharding.Leaf(0, 0, 0, 0.0)])


# 2 substrings


def brute_repeats(texts, least=200):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [500, 1])
@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_substring_dedup(request, monkeypatch, source, hot):
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", hot)
    frame = request.getfixturevalue(source)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.report(substring_dedup.remove_repeats(frame)).collect()]
    rows = pairs(frame)
    want = [(i, *w) for (i, _), w in zip(rows, brute_repeats([t.encode() for _, t in rows]))]
    assert Counter(got) == Counter(want)


def test_interval_expansion_against_counts():
    random_ = random.Random(3)
    for _ in range(60):
        least = random_.randint(2, 12)
        made = [bytes(random_.choice(b"ab\x00c"[: random_.randint(1, 4)]) for _ in range(random_.randint(least, 50))) for _ in range(random_.randint(1, 7))]
        contents = list(dict.fromkeys(made))
        weights = [random_.choice([1, 1, 2]) for _ in contents]
        seen = Counter()
        for c, w in zip(contents, weights):
            for i in range(len(c) - least + 1):
                seen[c[i : i + least]] += w
        want = [[seen[c[i : i + least]] > 1 for i in range(len(c) - least + 1)] for c in contents]
        assert [x.tolist() for x in substring_dedup.repeated_windows(contents, weights, least)] == want


# 3 chat


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hello"), ("assistant", "hi <|im_end|>"), ("user", None)
    talks = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, ("assistant", "other")], 6: [("user", "")], 7: [c], None: [a, b], 8: [c, c]}
    rows = [(i, n, r, t, "x") for i, turns in talks.items() for n, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = chat.format_conversations(frame).orderBy("conv_id", "turn_no").collect()
    assert {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got} == {(3, 3, 2), (5, 2, 1), (6, 1, 1), (8, 2, 1)}
    text = "".join(r["rendered"] for r in got if r["conv_id"] == 3)
    assert text == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [r["trained"] for r in got if r["conv_id"] == 3] == [False, True, False]
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark):
    rows = [(1, n, "user", f"t{n}") for n in range(700)] + [(2, n, "user", f"t{n}") for n in range(600)] + [(3, 0, "user", "t0"), (3, 0, "user", "t0")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(frame).groupBy("conv_id").agg(F.count("*"), F.max("turn_no"), F.countDistinct("turn_no")).collect()
    assert {tuple(r) for r in got} == {(1, 700, 700, 700), (3, 2, 2, 2)}


def test_null_turns_come_first(spark):
    rows = [(1, -300, "user", "a"), (1, None, "user", "b"), (1, -1, "user", "c"), (1, 5, "user", "d"), (1, None, "system", "e")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn_no"]: r["rendered"].split("\n")[1].split("<")[0] for r in chat.format_conversations(frame).collect()}
    assert got == {1: "e", 2: "b", 3: "a", 4: "c", 5: "d"}


def test_chat_runs_without_python(spark, sf_dir):
    plan = queries.QUERIES["op3_snapshot_chat_format"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4 quality


def test_quality_on_held_out_rows(spark, awkward, nothing):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op4_attention_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.7
    labels = spark.createDataFrame([(3, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    for frame in (awkward, nothing):
        got = quality.classify(frame, labels).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(frame))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)


def test_attention_gradients():
    random_ = np.random.default_rng(0)
    x, sizes, y = random_.normal(size=(9, quality.FEATURES)).astype(np.float32), np.array([2, 4, 3]), np.array([1, 0, 1], np.float32)
    model = quality.fit(x, sizes, y, epochs=1)
    model.weights = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}
    heads, rows = np.array([0, 2, 6]), np.repeat(np.arange(3), sizes)

    def loss():
        p = model.forward(x, heads, rows)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, gradient in model.gradients(x, heads, rows, y).items():
        at = tuple(0 for _ in np.shape(model.weights[name]))
        before = model.weights[name].copy()
        sides = []
        for step in (1e-5, -1e-5):
            model.weights[name] = before.copy()
            model.weights[name][at] += step
            sides.append(loss())
        model.weights[name] = before
        assert abs((sides[0] - sides[1]) / 2e-5 - np.asarray(gradient)[at]) < 1e-6, name


# 5 near duplicates


def brute_classes(rows):
    sequences = []
    for _, text in rows:
        w = words(text)
        sequences.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = defaultdict(set)
    for i, s in enumerate(sequences):
        for g in s or [()]:
            owners[g].add(i)
    shared = Counter((a, b) for o in owners.values() for a in o for b in o if a < b)
    for (a, b), many in shared.items():
        n, m = len(sequences[a]), len(sequences[b])
        if n + m == 0 or many >= 0.5 * max(len(set(sequences[a])), len(set(sequences[b]))) and lcs(sequences[a], sequences[b]) / (n + m - lcs(sequences[a], sequences[b])) >= 0.8:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups.values()


def lcs(a, b):
    places = defaultdict(int)
    for i, x in enumerate(b):
        places[x] |= 1 << i
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places[x]
        row = ((row + hit) | (row - hit)) & full
    return len(b) - bin(row).count("1")


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_near_classes(request, source):
    frame = request.getfixturevalue(source)
    rows = pairs(frame)
    want = Counter()
    for group in brute_classes(rows):
        ids = [rows[i][0] for i in group]
        known = [i for i in ids if i is not None]
        want.update((i, min(known) if known else None, len(group)) for i in ids)
    found = near_dedup.classes(frame).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == want
    kept = near_dedup.keep_documents(frame)
    assert kept.columns == frame.columns and kept.count() == len(list(brute_classes(rows)))


def test_alignment_is_exact_in_its_band():
    random_ = random.Random(1)
    for _ in range(400):
        a = [random_.randrange(50) for _ in range(random_.randint(1, 40))]
        b = [x if random_.random() > 0.08 else random_.randrange(50) for x in a if random_.random() > 0.04] + [1] * random_.randint(0, 3)
        common = lcs(a, b)
        want = common / (len(a) + len(b) - common) >= 0.8
        assert near_dedup.aligned_enough(np.array(a, np.uint32), np.array(b, np.uint32)) == want


def test_short_near_texts_have_a_key_in_common():
    """Every pair at 0.8 or more with a text of at most 12 shingles; sketches alone miss some of 30 000 pairs."""
    random_, texts, near = random.Random(3), [], []
    for i in range(30_000):
        base = [f"w{i}x{j if random_.random() > 0.1 else 0}" for j in range(8 if i % 2 else random_.randint(8, 16))]
        other = base + ["y"] if i % 2 else base[1:] + ["y"] * random_.randint(0, 1)
        texts += [" ".join(base), " ".join(other)]
    keys, n, nodes = [], [], []
    for batch in near_dedup._sketched([pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})], near_dedup.SHINGLE, near_dedup.SKETCHES, near_dedup.DRAWN):
        keys, n, nodes = (batch.column(c).to_pylist() for c in ("keys", "n", "node"))
    for i in range(0, len(texts), 2):
        a, b = (words(t) for t in texts[i : i + 2])
        a, b = ([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] for w in (a, b))
        common = lcs(a, b)
        if min(n[i], n[i + 1]) <= 12 and common / (len(a) + len(b) - common) >= 0.8:
            near.append(nodes[i] == nodes[i + 1] or bool(set(keys[i]) & set(keys[i + 1])))
    assert len(near) > 10_000 and all(near)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 7)
    random_, base, rows = random.Random(2), [f"w{i}" for i in range(260)], []
    for i in range(60):
        copy = list(base)
        for _ in range(random_.randint(0, 9)):
            copy[random_.randrange(len(copy))] = f"x{random_.random()}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in near_dedup.classes(frame).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == {frozenset(rows[i][0] for i in g) for g in brute_classes(rows)}


# 6 url rules


def test_url_rules(spark):
    urls = [
        "http://a.NET/x", "https://www.Example.net/en/x?q", "https://example.net/en", "http://example.net.evil.org/fr/", "x://org/fr/1", "http://b.org/fr", None, "no scheme",
        "", "http://", "http://net", "http://net/", "http://my-example.com/de/", "http://sub.example.com/de/#a", "HTTP://EXAMPLE.COM/DE/", "http://a.net?x=http://b.org/fr/", "http://a.net:80/y",
    ]
    frame = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls * 3)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/", "block")], "host string, path string, verdict string")

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = host.translate(LOWER)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    want = Counter((i if i else None, *judge(u)) for i, u in enumerate(urls * 3))
    for parts in (1, 5, 40):
        got = url_filters.match_rules(frame, rules, parts).collect()
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert url_filters.match_rules(frame, rules.limit(0)).filter("verdict <> 'allow'").count() == 0
    assert url_filters.match_rules(frame.limit(0), rules).count() == 0


# 7 decontamination


@pytest.mark.parametrize("block_words", [1 << 20, 40])
@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_decontamination(spark, sf_dir, request, source, block_words):
    frame = request.getfixturevalue(source)
    if source == "documents":
        items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    else:
        made = [(1, frame.filter("doc_id = 14").first()["text"] if source == "awkward" else "x y"), (2, "cd"), (None, "AB"), (4, None), (5, "..")]
        items = spark.createDataFrame(made, "item_id long, text string")
    windows = defaultdict(set)
    for row in items.collect():
        w = words(row["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("" if row["item_id"] is None else str(row["item_id"]))
    want = Counter()
    for doc_id, text in pairs(frame):
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    found = decontamination.contamination(frame, items, block_words=block_words)
    got = [tuple(r)[:6] for r in decontamination.report(found).collect()]
    assert Counter(got) == want
    cleaned = decontamination.remove_spans(found)
    assert cleaned.columns == frame.columns
    for row in decontamination.report(decontamination.contamination(cleaned, items)).collect():
        assert not row["contaminated"]


# 8 packing


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_packing(request, source):
    frame = request.getfixturevalue(source)
    tokens = encoder(WORD_BPE)
    want, lengths = Counter(), []
    for doc_id, text in pairs(frame):
        ids = np.array([*tokens.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    rows = packing.pack_documents(frame, WORD_BPE).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == best_fit(lengths, 2048)


def best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= length]
        if not fits:
            bins.append(capacity)
            fits = [(capacity, len(bins) - 1)]
        bins[min(fits)[1]] -= length
    return len(bins)


def test_plan_equals_one_by_one():
    random_ = random.Random(4)
    for _ in range(150):
        capacity = random_.randint(3, 60)
        lengths = [random_.randint(1, capacity) for _ in range(random_.randint(0, 150))]
        plan = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
        assert plan.bins == best_fit(lengths, capacity)
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({0: 1}, 5)


# 9 exact duplicates


@pytest.mark.parametrize("prime", [None, 3])
@pytest.mark.parametrize("huge", [1 << 23, 300])
@pytest.mark.parametrize("source", ["awkward", "nothing"])
def test_exact_classes(request, source, huge, prime):
    frame = request.getfixturevalue(source)
    groups = defaultdict(list)
    for doc_id, text in pairs(frame):
        groups[text.translate(LOWER)].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(ids):
            want[i, keep, len(ids), i == keep and n == ids.index(keep), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.classes(frame, prime, huge, chunk=64).collect())) == want
    kept = exact_dedup.keep_documents(frame)
    assert kept.columns == frame.columns and kept.count() == len(groups)


def test_fingerprints_compose():
    prime = exact_dedup.modulus()
    data = random.Random(1).randbytes(100_000)
    whole = exact_dedup.fingerprint(data, prime, 1 << 20)
    assert exact_dedup.fingerprint(data, prime, 777) == whole == int.from_bytes(data, "big") % prime
    assert exact_dedup.combine(exact_dedup.fingerprint(data[:333], prime), exact_dedup.fingerprint(data[333:], prime), len(data) - 333, prime) == whole


# 10 token counts


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_token_counts(request, source):
    frame = request.getfixturevalue(source)
    tokens, want = encoder(BYTE_BPE), Counter()
    for doc_id, text in pairs(frame):
        n = len(tokens.encode(text, add_special_tokens=False).ids)
        want[doc_id, len(text.encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts.count_tokens(frame, BYTE_BPE).collect())) == want


def test_pieces_encode_like_whole_texts():
    random_ = random.Random(6)
    counts, ids = ByteCounts(BYTE_BPE, limit=50), WordIds(WORD_BPE, limit=50)
    for _ in range(4000):
        text = "".join(random_.choice(" \nab'sé1\u0301<\t|,.ÉÀ\x1c\x85") for _ in range(random_.randint(0, 14)))
        assert counts.count(text) == len(encoder(BYTE_BPE).encode(text, add_special_tokens=False).ids), repr(text)
        assert ids.encode(text) == WordIds.packed(encoder(WORD_BPE).encode(text, add_special_tokens=False).ids), repr(text)
    assert len(counts) <= 50 and len(ids) <= 50


def test_paragraphs_are_counted_by_lookup(monkeypatch):
    """Blank lines, tabs, indents, special strings: pieces are short, and counts are the library's."""
    white = [*map(chr, range(9, 14)), *map(chr, range(28, 33)), "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000"]
    random_, counts = random.Random(8), ByteCounts(BYTE_BPE)
    for _ in range(6000):
        text = "".join(random_.choice([*white, " ", " ", "\n", "\n\n", "a", "'s", "12", "été", "<|endoftext|>", "?!"]) for _ in range(random_.randint(0, 12)))
        assert counts.count(text) == len(encoder(BYTE_BPE).encode(text, add_special_tokens=False).ids), repr(text)
    longest = []
    monkeypatch.setattr(ByteCounts, "ids", lambda self, piece: longest.append(len(piece)) or encoder(BYTE_BPE).encode(piece, add_special_tokens=False).ids)
    text = "  A first line, and more.\n\n\tAn indented one  with\xa0blanks.\r\n\n" * 5000
    assert ByteCounts(BYTE_BPE).count(text) == len(encoder(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert max(longest) <= 10 and len(longest) < 30


# pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("extra"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns and 0 < after.count() <= before
            assert after.count() == after.select("doc_id").distinct().count()
        if name == "exact_dedup":
            assert after.count() == docs.select(F.lower("text")).distinct().count()
        if name == "near_dedup":
            assert near_dedup.classes(after).filter("class_size > 1").count() == 0
        if name == "decontamination":
            assert after.count() == docs.count()
            assert decontamination.report(decontamination.contamination(after, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).filter("contaminated").count() == 0
        if name == "packing":
            assert after.select("doc_id").distinct().count() == docs.count()
        docs = after


def test_pipeline_on_awkward_rows(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(3, 1), (6, 0), (15, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "theta1 eta2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_keep_id", "_row", "row", "_sha", "sha", "_own_node", "node", "_quality_score", "_n_words", "n_words", "items", "_items", "spans", "_spans", "first", "keep_id", "keep_sha", "keep_node", "_n", "kept", "a.b", "a`b"]
    clashing = awkward.select("*", *[F.concat(F.lit(n), F.lit(" stays")).alias(n) for n in names])
    for docs in (awkward, clashing, nothing):
        before = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert docs.schema.simpleString() == before.schema.simpleString()
                docs = stored(docs, "awkward-stage")
                if before is clashing:
                    assert all(row[n] == f"{n} stays" for row in docs.collect() for n in names)
        docs.count()


THUE_MORSE = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(2048)) for flip in (0, 1)]


def test_words_of_one_pattern_stay_apart(spark):
    frame = spark.createDataFrame([(1, THUE_MORSE[0]), (2, THUE_MORSE[1]), (3, THUE_MORSE[0] + " " + THUE_MORSE[1])], "doc_id long, text string")
    items = spark.createDataFrame([(7, THUE_MORSE[0])], "item_id long, text string")
    found = decontamination.report(decontamination.contamination(frame, items)).collect()
    assert sorted((r["doc_id"], r["n_hit"]) for r in found) == [(1, 1), (2, 0), (3, 1)]
    assert near_dedup.classes(frame).filter("class_size > 1").count() == 0
    sequences = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(THUE_MORSE)], "doc_id long, text string")
    assert sequences.mapInArrow(lambda b: near_dedup._sketched(b, 5, 16, 3), "doc_id long, node binary, n long, keys array<long>").select("node").distinct().count() == 2


def test_words_with_equal_hashes_are_compared(monkeypatch):
    random_ = random.Random(9)
    texts = [bytes(random_.choice(b"abc") for _ in range(random_.choice([1, 7, 8, 9, 17, 1030]))) for _ in range(300)]
    texts += [t[:-1] + b"x" for t in texts]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    left, right = (np.array([random_.randrange(len(texts)) for _ in range(4000)]) for _ in range(2))
    right[::2] = left[::2]
    same = same_words(data, bounds[left], bounds[left + 1], data, bounds[right], bounds[right + 1])
    assert same.tolist() == [texts[a] == texts[b] for a, b in zip(left, right)]
    codes = word_codes(data, bounds[:-1], bounds[1:])
    assert len(set(codes.tolist())) == len(set(texts)) and (codes != word_codes(data, bounds[:-1], bounds[1:], 1)).all()


def test_repeated_rows_keep_one(spark):
    """One row in many copies, null ids among them: one stays, no window holds the copies."""
    rows = [(None if i % 2 else 5, "the same words in every row of it") for i in range(400)] + [(6, "others")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for operator in (exact_dedup, near_dedup):
        found = operator.classes(frame)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in found.filter("kept").collect()) == [5, 6]
        assert sorted(r["doc_id"] for r in operator.keep_documents(frame).collect()) == [5, 6]


def test_pipeline_is_reproducible(spark, sf_dir):
    import corpus_pipeline

    runs = [corpus_pipeline.run(spark, sf_dir) for _ in range(2)]
    assert canonical_rows(runs[0].columns, runs[0].collect()) == canonical_rows(runs[1].columns, runs[1].collect())
