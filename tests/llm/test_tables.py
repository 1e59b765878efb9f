"""Operators over whole tables, against plain versions."""

import gzip
import io
import random
from hashlib import sha1, sha256

import numpy as np
import pandas as pd
import pytest
import xxhash

from chronolake.llm import chat, rabitq, simhash, warc
from chronolake.llm.common import shared_dir

# ---------------------------------------------------------------- near-duplicates


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["A", "b", "É", " ", "\t", "\n", "\x1c", "\xa0", "word ", "two "]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_prints(n, seed):
    """Fingerprints in chains and clusters: each a random one or a few flips from an earlier one; many share high bits."""
    rng = random.Random(seed)
    out = [0]
    for _ in range(n):
        x = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(out)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("bucket", [2, 16, 256])
def test_links_have_the_components_of_all_pairs(spark, bucket):
    fps = near_prints(500, bucket)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(nodes, 2, bucket).collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in got)
    at = {signed(x): i for i, x in enumerate(fps)}
    sets = simhash.Sets(len(fps))
    for a, b in got:
        sets.join(at[a], at[b])
    assert [sets.root(i) for i in range(len(fps))] == plain_components(fps)


@pytest.mark.parametrize("parts", [[(list(range(32)), 0), (list(range(32, 64)), 1)], [(list(range(0, 64, 2)), 2)][:0] or [(list(range(20)), 1), (list(range(20, 40)), 0)]])
def test_thresholds_over_zero(spark, parts):
    fps = near_prints(200, 8)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {(r.a, r.b) for r in simhash.links(nodes, 2, 64, parts).where("b is not null").collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in found)


def test_plan_follows_the_principle(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 64))
    x[:, 32:40] = x[:, :8]  # bits that go together
    parts = simhash.correlated_parts(x.astype(float), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert sum(len({b, b + 32} & set(p)) == 2 for b in range(8) for p in parts) >= 6
    assert simhash.allot([[0, 9, 10], [0, 1, 2], [0, 1, 2]], -1) in ([-1, 0, 0], [-1, -1, 1], [-1, 1, -1])
    nodes = spark.createDataFrame([(signed(v),) for v in near_prints(100, 1)], "fp long")
    for radius in (0, 2, 4):
        plan = simhash.plan(nodes, radius)
        used, thresholds = sum(len(p) for p, _ in plan), [t for _, t in plan]
        assert used <= 64 and sum(t + 1 for t in thresholds) == radius + 1


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)) for _ in range(12)]
    texts = [*base, *(b.replace(b.split()[7], "other") for b in base), base[0], base[0].upper(), "", None, " ", "long " * 30_000]
    rows = [(100 - i, t, "v") for i, t in enumerate(texts)] + [(None, base[1], "v"), (100, base[0], "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    roots = plain_components(fps)
    want = {r: min((i for (i, _, _), q in zip(rows, roots, strict=True) if q == r and i is not None), default=None) for r in roots}
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1, r.component_id) for r in got) == sorted((i or -1, f, want[r]) for (i, _, _), f, r in zip(rows, fps, roots, strict=True))
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_wide_fingerprints_follow_similarity():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = words[:400]

    def similarity(a, b):
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    far = []
    for _ in range(40):
        other = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
        a, b = (simhash.wide_fingerprint(" ".join(x)) for x in (base, other))
        far.append((similarity(base, other), int(np.bitwise_count((a ^ b).view(np.uint64)).sum())))
    expected = [256 * np.arccos(2 * j / (1 + j)) / np.pi for j, _ in far]
    assert abs(np.mean([d for _, d in far]) - np.mean(expected)) < 3
    assert simhash.wide_radius(0.8) == 44


def flipped(fp, bits):
    """A copy of four longs with these bits turned."""
    x = np.unpackbits(fp.view(np.uint8), bitorder="little")
    x[list(bits)] ^= 1
    return np.packbits(x, bitorder="little").view(np.int64)


def wide_nodes(spark, fps):
    return spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(fps)], "node long, fp array<long>")


def wide_components(spark, fps, radius=44):
    links = [(r.a, r.b) for r in simhash.wide_links(wide_nodes(spark, fps), radius).collect()]
    assert all(np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)).sum() <= radius for a, b in links)
    sets = simhash.Sets(len(fps))
    for a, b in links:
        sets.join(a, b)
    return [sets.root(i) for i in range(len(fps))]


def test_meeting_chance_holds_at_every_size(spark):
    for count in (0, 1, 9_000, 200_000, 11_000_000, 1 << 40):
        size, samples = simhash.sampling(count, 44)
        assert (1 - simhash.meeting(size, 44)) ** samples <= 0.0011, count
    # At the size for eleven million nodes, pairs at the radius itself are still found.
    rng = np.random.default_rng(6)
    one = rng.integers(-(1 << 63), 1 << 63, (200, 4))
    fps = np.concatenate([one, [flipped(x, rng.choice(256, 44, replace=False)) for x in one]])
    sampling, simhash.sampling = simhash.sampling, lambda count, radius: sampling(11_000_000, radius)
    try:
        roots = wide_components(spark, fps)
    finally:
        simhash.sampling = sampling
    assert sum(a == b for a, b in zip(roots[:200], roots[200:], strict=True)) >= 198


def test_copies_behind_a_stranger_are_compared():
    """Each key has a stranger first, then two copies of each other."""
    rng = np.random.default_rng(3)
    fps = rng.integers(-(1 << 63), 1 << 63, (3, 4))
    fps[2] = flipped(fps[1], range(30))
    rows = pd.DataFrame({"key": 5, "node": [0, 1, 2], **{f"f{k}": fps[:, k] for k in range(4)}})
    for batches in ([rows], [rows[:1], rows[1:2], rows[2:]]):
        got = pd.concat(simhash._compared(44)(iter(batches)))
        assert [sorted(x) for x in got.to_numpy().tolist()] == [[1, 2]]


@pytest.mark.parametrize("square", [8, 1024])
def test_joined_is_the_components_of_all_pairs(monkeypatch, square):
    monkeypatch.setattr(simhash, "SQUARE", square)
    rng = np.random.default_rng(square)
    fps = [rng.integers(-(1 << 63), 1 << 63, 4)]
    for _ in range(150):
        fps.append(flipped(fps[rng.integers(len(fps))], rng.choice(256, rng.integers(10, 60), replace=False)))
    fps = np.array(fps)
    want, got = simhash.Sets(len(fps)), simhash.Sets(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if simhash._apart(fps[i : i + 1], fps[j])[0] <= 44:
                want.join(i, j)
    assert all([got.join(i, j) for i, j in simhash.joined(fps, 44)])
    assert [got.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]


def test_large_bucket_is_searched_whole(spark):
    """All nodes agree in all but 80 bits that few samples take up; pairs in it are far from any one representative."""
    rng = np.random.default_rng(8)
    base, fps = rng.integers(-(1 << 63), 1 << 63, 4), []
    for _ in range(300):
        one = flipped(base, 176 + np.flatnonzero(rng.random(80) < 0.6))
        fps += [one, flipped(one, rng.choice(176, 12, replace=False))]
    fps = np.array(fps)
    want = simhash.Sets(len(fps))
    for i, j in simhash.joined(fps, 30):
        want.join(i, j)
    assert wide_components(spark, fps, 30) == [want.root(i) for i in range(len(fps))]


def test_copies_go_and_others_stay(spark):
    rng = random.Random(5)

    def words(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]

    base = [words(300) for _ in range(30)]
    near = [[*b[:100], "other", *b[101:200], "word", *b[200:]] for b in base]  # about 0.93 similar
    rows = [(i, " ".join(w), "x") for i, w in enumerate([*base, *near])]
    rows += [(200 + i, " ".join(base[0]), "x") for i in range(400)]  # a third of all rows and more are one text
    rows += [(70, None, "x"), (71, "", "x"), (72, " \n", "x"), (None, " ".join(base[1]), "x"), (5, " ".join(base[5]), "x"), (80, "long words go on " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, *range(30), 70, 80]
    assert simhash.keep_first(docs.where("false")).collect() == []


def test_meetings_over_batches():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 300))
    node = np.concatenate([np.sort(rng.choice(1000, (key == k).sum(), replace=False)) for k in np.unique(key)])
    whole = pd.DataFrame({"key": key, "node": node, **{f"f{k}": node % 4 for k in range(4)}})
    frames = [whole[a:b] for a, b in ((0, 1), (1, 7), (7, 7), (7, 150), (150, 300))]
    got = [(a, b) for f in simhash._meetings(4)(iter(frames)) for a, b in zip(f["a"], f["b"], strict=True)]
    sets, want = simhash.Sets(1000), simhash.Sets(1000)
    for a, b in got:
        sets.join(a, b)
    for k in np.unique(key):
        x = node[key == k].tolist()
        for y in x[1:]:
            if 4 * bin((x[0] % 4) ^ (y % 4)).count("1") <= 4:
                want.join(x[0], y)
    assert [sets.root(i) for i in range(1000)] == [want.root(i) for i in range(1000)] and len(got) < 1000


def test_components_of_a_chain(spark):
    n = 60
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[:300] = x[0] + 0.01 * rng.normal(size=(300, 24))  # a third close together
    x[5:9] = x[4]  # ties
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x)]
    odd = [(2000, None, "n"), (2050, [0.0] * 24, "z"), (2100, [float("nan")] * 24, "n"), (2150, [None, *[1.0] * 23], "n"), (2200, [float("inf")] * 24, "i"), (None, [1.0] * 24, "x"), (3000, [1.0, 2.0], "short"), (3001, [1.0, 2.5], "short"), (2250, [], "e")]
    d = spark.createDataFrame([*rows, *odd, rows[7]], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in rabitq.nearest(d, d.where("vec_id % 50 = 0"), block_rows=128, query_rows=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    unit = y / np.sqrt((y * y).sum(1))[:, None]
    assert set(got) == {*range(0, 900, 50), 3000}
    hit = total = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        want = [int(i) for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:5]
        mine = [v for _, v, _ in sorted(got[q])]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(want) & set(mine)), total + 5
        assert all(abs(z - s[v]) < 1e-12 for _, v, z in got[q])
    assert hit >= 0.98 * total
    assert [(r, v) for r, v, _ in got[3000]] == [(1, 3001)]
    assert rabitq.nearest(d.where("false"), d.where("false")).collect() == []


def test_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    turn = rotation = rabitq.rotation(64, 256)
    assert np.allclose(rotation @ rotation.T, np.eye(64))
    codes, f = rabitq.encode(x, turn)
    q = rabitq.Query(x[0], turn)
    est = q.estimate(codes, np.bitwise_count(codes).sum(1, dtype=np.int64), f)
    off = np.abs(est - x @ x[0])
    assert (off <= rabitq.bound(f, 256) + q.slack / f).mean() > 0.995
    assert abs((est - x @ x[0])[1:].mean()) < 0.01


# ---------------------------------------------------------------- chat


def conversations(spark):
    rows = [(1, 0, "system", "be <|im_end|> brief"), (1, 1, "user", "a\\b\n</s>[INST]"), (1, 2, "assistant", "<|im_start|>assistant\nno<|im_end|>\n"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "left over")]
    rows += [(2, 1, "assistant", "second"), (2, 0, "assistant", "first"), (3, None, None, None), (4, 0, "us\ner<s>", "x"), (4, 0, "us\ner<s>", "x"), (None, 1, "assistant", "nobody"), (5, 0, "user", "long " * 40_000)]
    rows += [(6, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(200)]
    return spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")


def test_examples(spark):
    got = [r for r in chat.examples(conversations(spark)).collect() if r.conv == 1]
    assert [r.example for r in got] == [0, 1, 2]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in got[:2]] == ["<|im_start|>assistant\nno<|im_end|>\n", ""]
    assert got[2].loss_start is None and got[2].text.startswith(got[1].text) and got[1].text.startswith(got[0].text)
    assert got[0].text.count(chat.OPEN) == 3 and "</s>" not in got[0].text and "[INST]" not in got[0].text
    assert [(a, b) for a, b, _, _ in chat.parse_turns(got[0].text)] == [("system", "be <|im_end|> brief"), ("user", "a\\b\n</s>[INST]"), ("assistant", "<|im_start|>assistant\nno<|im_end|>\n")]


def test_read_back(spark):
    d = conversations(spark)
    want = {}
    for r in sorted(d.collect(), key=lambda r: (r.turn is not None, r.turn or 0)):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv: r for r in chat.digests(d).collect()}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
    assert chat.digests(d.where("false")).collect() == []


def test_escaping_is_reversible():
    rng = random.Random(6)
    for _ in range(3_000):
        t = "".join(rng.choice([*chat.CONTROL, "\\", "<", "|", "[", "\n", "x", "<|im_", "end|>"]) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


# ---------------------------------------------------------------- archives


def test_archives(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (3, "u3", "same"), (4, None, None), (6, "u\r\n6", ""), (7, "u7", "é" * 700_000), (8, "u8", "WARC/1.1\r\n\r\n"), (None, "n", "same"), (9, "u9", "own")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    table = warc.archive_pages(d.repartition(3), archive_bytes=100)
    got = warc.read_archives(table).collect()
    assert len(got) == len(rows) and sum(r.records for r in table.collect()) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    import base64

    for r in got:
        html = {i: h or "" for i, _, h in rows}[r.page_id]
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(sha1(raw).digest()).decode())
        first = r.page_id is None or least[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", least[html]))
        assert (bytes(r.payload) if first else None) == (raw if first else r.payload)
    assert {r.uri for r in got if r.page_id == 6} == {"u%0D%0A6"}
    assert warc.read_archives(warc.archive_pages(d.where("false"))).collect() == []


def test_small_payloads_do_not_refer(spark):
    d = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.archive_pages(d, min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_normalising_a_stream():
    records = [warc.record(i, "u", bytes([i]) * (i * 70_000), None) for i in range(5)]
    for whole in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise_stream(io.BytesIO(whole), out, index) == 5
        entries = pd.read_json(io.BytesIO(index.getvalue()), lines=True)
        for i, e in enumerate(entries.itertuples()):
            fields, block = warc.read_record(out, e.offset, e.length)
            assert block.endswith(bytes([i]) * (i * 70_000)) and fields["x-page"] == str(i)
            assert gzip.decompress(out.getvalue()[e.offset : e.offset + e.length]) == records[i]
    with pytest.raises(ValueError):
        warc.normalise_stream(io.BytesIO(gzip.compress(b"".join(records))[:-9_0]), io.BytesIO(), io.BytesIO())
    with pytest.raises(ValueError):
        warc.normalise_stream(io.BytesIO(gzip.compress(b"nothing\r\n\r\n")), io.BytesIO(), io.BytesIO())


def test_shared_folder(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


# ---------------------------------------------------------------- near copies by similarity


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def damaged(rng, w, similarity):
    """Words of ``w`` changed one by one until the shingles' similarity is just over the wanted one."""
    out, places = list(w), list(range(len(w)))
    rng.shuffle(places)
    own = shingles(" ".join(w))
    for at in places:
        was, out[at] = out[at], f"x{rng.randrange(10**9)}"
        other = shingles(" ".join(out))
        if len(own & other) / len(own | other) < similarity:
            out[at] = was
            break
    return " ".join(out)


@pytest.mark.parametrize("low", [0.8, 0.85, 0.9, 0.95])
def test_recall_by_bands_of_similarity(spark, low):
    """Planted pairs with a similarity from ``low`` to 0.05 more, each beside texts of other words: 0.9 of them lose a document, strangers none."""
    rng = random.Random(int(low * 100))
    rows, n = [], 120
    for i in range(n):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 900))]
        rows += [(i, " ".join(w)), (1_000 + i, damaged(rng, w, rng.uniform(low, low + 0.05)))]
        rows.append((5_000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(n)) | set(range(5_000, 5_000 + n)) <= kept
    assert sum(1_000 + i not in kept for i in range(n)) >= 0.9 * n


def test_repeated_ids_lose_no_text(spark):
    """Rows of one id with other texts are documents of their own; the choice doesn't hang on partitions or columns."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(200)) for x in "abc")
    rows = [(1, a, "p", 1), (1, b, "q", 2), (1, b, "r", 3), (2, c, "s", 4), (3, a, "t", 5), (3, b + " more", "u", 6), (None, a, "v", 7), (4, None, "w", 8), (4, "", "x", 9)]
    kinds = "doc_id long, text string, __id string, mark int"
    found = []
    for n in (1, 3):
        d = spark.createDataFrame(rows, kinds).repartition(n)
        kept = simhash.keep_first(d)
        assert kept.columns == d.columns
        found.append(sorted(map(str, kept.collect())))
    assert found[0] == found[1]
    texts = [r.split("text='")[1].split(" ")[0] if "text='" in r and "text=''" not in r else "" for r in found[0]]
    assert sorted(texts) == sorted(["", a.split()[0], a.split()[0], b.split()[0], c.split()[0]])


@pytest.mark.parametrize(("radius", "bucket"), [(0, 4), (1, 4), (3, 4), (3, 256), (5, 16), (20, 4)])
def test_every_radius_works_at_every_size(spark, radius, bucket):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(1 << 63), 1 << 63, 20)
    fps = {int(x) for x in base}
    for x in base[:8]:
        for _ in range(60):
            y = int(x) & ((1 << 64) - 1)
            for bit in rng.choice(24, rng.integers(0, 7), replace=False):
                y ^= 1 << int(bit)
            fps.add(y - (1 << 64) if y >> 63 else y)
    nodes = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    order = {x: i for i, x in enumerate(sorted(fps))}
    got, want = simhash.Sets(len(order)), simhash.Sets(len(order))
    for r in simhash.links(nodes, radius, bucket).collect():
        got.join(order[r.a], order[r.b])
    u = np.array(sorted(fps), np.int64).view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= radius):
            want.join(int(j), i)
    assert [got.root(i) for i in range(len(u))] == [want.root(i) for i in range(len(u))]
    with pytest.raises(ValueError):
        simhash.plan(nodes, 64)


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_stars_have_the_same_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    pairs = [(-a, b) for a, b in pairs if -a != b]
    got = simhash.stars(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    nodes = {x: i for i, x in enumerate(sorted({x for p in pairs for x in p}))}
    one, two = simhash.Sets(len(nodes)), simhash.Sets(len(nodes))
    for a, b in pairs:
        one.join(nodes[a], nodes[b])
    for a, b in got:
        assert a < b
        two.join(nodes[a], nodes[b])
    assert [one.root(i) for i in range(len(nodes))] == [two.root(i) for i in range(len(nodes))]
    assert simhash.stars(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_addresses_and_text_ids(spark):
    rows = [("p/1", "u" * 3_000_000, "same"), ("p 2\n", "v", "same"), ("", "w", "other"), (None, None, None)]
    d = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, len(r.uri)) for r in warc.read_archives(warc.archive_pages(d), id_type="string").collect()}
    assert got == {"p/1": ("revisit", "p 2\n", 3_000_000), "p 2\n": ("response", None, 1), "": ("response", None, 1), None: ("response", None, 0)}


def test_text_ids_of_conversations(spark):
    d = spark.createDataFrame([("b", 0, "user", "x"), ("a", 0, "user", "y"), ("a", 1, "assistant", "z")], "conv_id string, turn long, role string, text string")
    assert sorted((r.conv, r.n_turns) for r in chat.digests(d).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("low", [0.6, 0.7, 0.75])
def test_texts_below_the_similarity_stay(spark, low):
    """Pairs under 0.8 stay both, though many of their fingerprints lie within the radius; a third text over 0.8 to one of them goes."""
    rng = random.Random(int(low * 100))
    rows, n = [], 60
    for i in range(n):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 600))]
        rows += [(i, " ".join(w)), (1_000 + i, damaged(rng, w, low + 0.005)), (2_000 + i, damaged(rng, w, 0.9))]
    assert all(len(shingles(a[1]) & shingles(b[1])) < 0.8 * len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::3], rows[1::3], strict=True))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Two damaged copies of one text can be similar by way of it alone.
    assert set(range(n)) <= kept and not any(2_000 + i in kept for i in range(n))
    assert set(range(1_000, 1_000 + n)) <= kept


def test_near_copies_are_the_components_of_similar_pairs(spark):
    """Against all pairs: families of texts that drift away from each other step by step."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 300))]
        for _ in range(8):
            texts.append(" ".join(w))
            for _ in range(max(1, len(w) // rng.choice([20, 40, 80]))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
    sets = [shingles(t) or {t} for t in texts]
    want = simhash.Sets(len(texts))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.join(i, j)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    roots = [want.root(i) for i in range(len(texts))]
    least = {r: roots.index(r) for r in roots}
    assert all(roots[got[i]] == roots[i] for i in range(len(texts)))
    assert sum(got[i] != least[roots[i]] for i in range(len(texts))) <= 0.02 * len(texts)


@pytest.mark.parametrize("square", [8, 1024])
def test_nearest_joined(monkeypatch, square):
    """The components of all pairs within the radius; in small buckets the least distances in all."""
    monkeypatch.setattr(simhash, "SQUARE", square)
    rng = np.random.default_rng(square)
    fps = [rng.integers(-(1 << 63), 1 << 63, 4)]
    for _ in range(120):
        fps.append(flipped(fps[rng.integers(len(fps))], rng.choice(256, rng.integers(10, 60), replace=False)))
    fps = np.array(fps)
    pairs = sorted((int(simhash._apart(fps[i : i + 1], fps[j])[0]), i, j) for i in range(len(fps)) for j in range(i))
    want, total = simhash.Sets(len(fps)), 0
    for d, i, j in pairs:
        if d <= 44 and want.join(i, j):
            total += d
    found, got = simhash.nearest_joined(fps, 44), simhash.Sets(len(fps))
    assert all(got.join(int(i), int(j)) for i, j, _ in found)
    assert [got.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]
    assert all(simhash._apart(fps[i : i + 1], fps[j])[0] == d for i, j, d in found)
    assert found[:, 2].sum() == total if square == 1024 else found[:, 2].sum() >= total


def test_parts_of_similar_sets_agree():
    """Sets that differ in as many shingles as the similarity allows have a key in common, whatever their sizes."""
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.95):
        for _ in range(700):
            small = int(np.exp(rng.uniform(0, np.log(400))))
            large = int(rng.integers(small, int(small / similarity + 1e-9) + 1))
            both = int(np.ceil(similarity / (1 + similarity) * (small + large) - 1e-9))
            pool = rng.integers(0, 1 << 64, small + large, dtype=np.uint64)
            a, b = np.sort(pool[:small]), np.sort(np.r_[pool[:both], pool[small : small + large - both]])
            if both <= small:
                keys = [simhash.part_keys(x, similarity) for x in (a, b)]
                assert len(np.intersect1d(*keys)), (small, large, both)
    a = rng.integers(0, 1 << 64, (2, 300), dtype=np.uint64)
    assert not len(np.intersect1d(*(simhash.part_keys(np.sort(x), 0.8) for x in a)))
    assert len(simhash.part_keys(np.zeros(0, np.uint64), 0.8)) == 0


def test_chosen_parts_are_the_allotted_ones():
    """Thresholds -1 and 0 of least cost, by the dynamic programme and by choosing the cheapest parts."""
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
    starts = np.sort(rng.choice(np.arange(1, 60), 19, replace=False))
    starts = np.r_[0, starts]
    prints = simhash.part_prints(h, starts)
    for p, part in zip(prints, np.split(h, starts[1:]), strict=True):
        assert p == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in part) > len(part))
    costs = [[0.0, float(c)] for c in rng.permutation(100)[:20]]
    chosen = simhash.allot(costs, 12 - 20 + 1)
    assert sorted(np.flatnonzero(np.array(chosen) == 0)) == sorted(np.argsort([c[1] for c in costs])[:13])


def test_copies_with_fingerprints_far_apart_go(spark):
    """Pairs over 0.8 whose wide fingerprints differ by more than 2.5 standard errors over what is expected."""
    rng, rows = random.Random(8), []
    while len(rows) < 24:
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
        one, two = " ".join(w), damaged(rng, w, 0.8)
        a, b = (simhash.wide_fingerprint(x) for x in (one, two))
        if np.bitwise_count((a ^ b).view(np.uint64)).sum() > simhash.wide_radius(0.8, 2.5):
            rows += [(len(rows), one), (len(rows) + 1, two)]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 24, 2))


def test_groups_of_shared_keys():
    """Keys over batches, repeated rows, and a key that is alone in several batches."""
    rng = np.random.default_rng(4)
    key = np.sort(np.r_[rng.integers(-20, 20, 150), np.full(60, 3)])
    whole = pd.DataFrame({"key": key, "node": rng.integers(0, 12, len(key))}).sort_values(["key", "node"], ignore_index=True)
    want = {frozenset(g["node"]) for _, g in whole.groupby("key") if g["node"].nunique() > 1}
    for step in (1, 7, 1000):
        frames = [whole[a : a + step] for a in range(0, len(whole), step)]
        got = pd.concat(simhash._shared(iter(frames))).drop_duplicates()
        assert {frozenset(g["node"]) for _, g in got.groupby("group")} == want


@pytest.mark.parametrize("group", [4, 4096])
def test_large_groups_are_searched_whole(spark, monkeypatch, group):
    """Groups cut into blocks give the components of all pairs."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BLOCKS", 10)
    rng = np.random.default_rng(group)
    fps = [rng.integers(-(1 << 63), 1 << 63, 4)]
    for _ in range(120):
        fps.append(flipped(fps[rng.integers(len(fps))], rng.choice(256, rng.integers(10, 60), replace=False)))
    rows = [(i, [int(v) for v in x], [7, 100 + i % 3]) for i, x in enumerate(fps)]
    prints = spark.createDataFrame(rows, "node long, fp array<long>, keys array<long>")
    got, want = simhash.Sets(len(fps)), simhash.Sets(len(fps))
    for r in simhash.part_links(prints, prints.select("node", "fp"), 44).collect():
        assert simhash._apart(fps[r.a][None], fps[r.b])[0] == r.d <= 44
        got.join(r.a, r.b)
    for i in range(len(fps)):
        for j in range(i):
            if simhash._apart(fps[i][None], fps[j])[0] <= 44:
                want.join(i, j)
    assert [got.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]
