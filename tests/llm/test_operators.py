"""Each operator against a brute-force version, and with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, language, licenses, mixing, pieces, simhash, substring_dedup, toxicity, transport, url_filter
from docloom.llm._graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, size long, norm string, fp long, word string, part string, block string"
WORDS = [a + b for a in "ba ke li mo nu".split() for b in "r st la n que".split()]


def texts(seed=1, n=60):
    """Prose with copies, near copies, shared passages, white space, nulls, empty and long texts."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS).capitalize() if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(k))
    passage, out = say(40), []
    for _ in range(n):
        kind = rng.random()
        t = say(rng.choice([1, 2, 3, 5, 20, 80]))
        if kind < 0.2 and out:
            t = rng.choice(out) or ""
        elif kind < 0.35 and out:
            t = (rng.choice(out) or "").replace(" ", rng.choice(["  ", "\n", "\t \r\n"]), 2)
        elif kind < 0.5:
            t = f"{say(7)} {passage} {say(9)}"
        elif kind < 0.55:
            t = None
        elif kind < 0.6:
            t = rng.choice(["", " \n\t", "é ñ ß œ", "\u00a0x\u00a0", "a"])
        out.append(t)
    return [*out, say(6000), " ".join(["bar"] * 3000), passage * 2]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    ids = list(range(len(rows)))
    random.Random(3).shuffle(ids)
    data = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "a"][i % 4], None, "k", 1, "n", 2, "w", "p", "b") for i, t in zip(ids, rows, strict=True)]
    data += data[:2] + [(None, "null id", "en", "a", 1, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(i):
    return (1 << 63) - 1 if i is None else i


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_transport_round_trip_and_damage():
    rng = random.Random(2)
    for n in [*range(1, 400), 16383, 16384, 16385, 70_000]:
        payload = rng.randbytes(n)
        got = transport.demultiplex(transport.multiplex(payload))
        assert got.payload(transport.DATA_PID) == payload
        assert (got.continuity_errors, got.crc_errors, got.damaged, got.lost_sync) == (0, 0, 0, 0)
        assert got.programs == {1: transport.PMT_PID} and got.streams == {transport.DATA_PID: 6}
        assert [u[1] for u in got.units] == [transport.TICKS * (k + 1) for k in range(len(got.units))] and all(u[4] for u in got.units)
    payload = rng.randbytes(40_000)
    media = transport.multiplex(payload)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    lost = transport.demultiplex(b"".join(packets[:20] + packets[21:]))
    assert lost.continuity_errors == 1 and lost.damaged == 1
    twice = transport.demultiplex(b"".join(packets[:20] + [packets[19]] + packets[20:]))
    assert twice.duplicates == 1 and twice.payload() == payload
    shifted = transport.demultiplex(b"\x00\x47junk" + media)
    assert shifted.payload() == payload and shifted.lost_sync >= 1
    broken = bytearray(media)
    broken[188 + 14] ^= 1
    assert transport.demultiplex(bytes(broken)).crc_errors == 1
    assert transport.demultiplex(None).packets == transport.demultiplex(b"").packets == transport.demultiplex(b"x" * 500).packets == 0


def test_transport_query(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = rows_of(transport.op1_transport_stream(spark, str(tmp_path)))
    assert len(out) == docs(spark).count()
    by = defaultdict(list)
    for r in docs(spark).collect():
        by[r["doc_id"]].append((r["text"] or "").encode())
    for r in out:
        t = by[r["doc_id"]][0]
        payload = t + bytes(-len(t) % 64) if t else bytes(64)
        assert r["n_bytes"] == len(t) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] % 188 == 0
    parsed = transport.parse_column(transport.multiplex_column(docs(spark), "text", "doc_id"), "media", "doc_id").collect()
    assert all(p["units"][0]["random_access"] and bytes(p["payload"]).rstrip(b"\0") == by[p["doc_id"]][0] for p in parsed)


def test_content_sort(spark):
    df = docs(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in df.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    out = rows_of(exact_dedup.content_sort(df))
    want = sorted((key(i), min(map(key, ids)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert all(r["kept"] == (key(r["doc_id"]) == key(r["keep_id"])) for r in out)
    assert exact_dedup.content_sort(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", ["2", "9", "40"])
def test_content_sort_across_borders(spark, parts):
    """One text with most of the rows: its run crosses many partitions, whole ones included."""
    rows = [(i, "x" if i % 10 else f"y{i % 30}") for i in range(400)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = rows_of(exact_dedup.content_sort(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in out} == {i: (min(g), len(g)) for g in ids.values() for i in g}


def slow_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_simhash(spark):
    df = docs(spark)
    all_rows = df.collect()
    fp = [slow_fingerprint(r["text"]) for r in all_rows]
    root = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 3])
    least = {}
    for i, r in enumerate(all_rows):
        least[root[i]] = min(least.get(root[i], key(None)), key(r["doc_id"]))
    want = sorted((key(r["doc_id"]), f"{fp[i]:016x}", least[root[i]]) for i, r in enumerate(all_rows))
    out = rows_of(simhash.near_duplicates(df))
    assert sorted((key(r["doc_id"]), r["fingerprint"], key(r["component_id"])) for r in out) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [4, 64, 10_000])
def test_near_components_of_dense_blocks(spark, dense):
    """Clusters that share blocks, chains of three-bit steps, and lone fingerprints; small limits take the finer and the bit-flip ways."""
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(3):
        at = rng.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            for b in rng.sample(range(64), 3):
                at ^= 1 << b
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(60)}
    fps = sorted(fps)
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r["fp"]: r["root"] for r in simhash.near_components(spark.createDataFrame([(sign(x),) for x in fps], "fp long"), dense).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for i, x in enumerate(fps):
        mine[root[i]].add(sign(x))
        theirs[got.get(sign(x), sign(x))].add(sign(x))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(60)]
    root = roots(200, links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(i, i) == least[root[i]] for i in range(200))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("how", [{}, {"block_words": 40}, {"hot": 0}, {"hot": 2, "block_words": 100}])
def test_relative_factors(spark, how):
    """Small blocks, and minimizers with too many pieces, which are dealt by single windows, give the same words."""
    df = docs(spark)
    all_rows = [(key(r["doc_id"]), re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()]
    first = {}
    for i, w in all_rows:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, w in all_rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    out = rows_of(substring_dedup.factors(df, **how))
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(want)
    assert sum(w[2] for w in want) > 500
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in out)
    assert substring_dedup.factors(empty(spark)).count() == 0


def test_relative_factors_of_periods(spark):
    """Words that recur within a window give one minimizer for hundreds of windows, of which each is judged."""
    rng = random.Random(7)
    rows = [(1, (["a", "b"] * 7)[:13]), (2, ["a", "b"] * 100), (3, ["b", "a"] * 60)]
    for i in range(4, 60):
        cycle = [f"w{rng.randrange(3)}" if rng.random() < 0.3 else f"v{j}" for j in range(i % 6 + 2)]
        w = (cycle * 60)[rng.randrange(i % 6 + 2) :][: rng.randrange(10, 400)]
        rows.append((i, w + [f"z{i}"] + w[: rng.randrange(200)]))
    first, want = {}, []
    for i, w in rows:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    out = rows_of(substring_dedup.factors(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == want


def test_pieces_parity_and_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["a  b", " lead", "trail ", "   ", "x\ny\tz", "▁ mark ▁▁", "日本語 😀 ẞ", "a" * 5000, "tab\t tab", "\u00a0", "<s> </s> <unk> <0x0A>", "1234567890 1.5e3", "''\"", "a\u0301"]
    df = docs(spark, [t for t in texts() if t is None or len(t) < 50_000] + odd)
    out = rows_of(pieces.encode_column(df))
    by = defaultdict(list)
    for r in df.collect():
        by[r["doc_id"]].append(r["text"] or "")
    assert all(r["ids"] == sp.encode(by[r["doc_id"]][0]) and r["n_tokens"] == len(r["ids"]) for r in out)
    assert all(r["agrees"] for r in out)
    back = rows_of(pieces.decode_column(pieces.encode_column(df)))
    # a literal marker decodes to a space, in the sentencepiece library too
    assert all(r["text"] == by[r["doc_id"]][0].replace(pieces.MARK, " ") for r in back)
    assert all(sp.decode(r["ids"]) == by[r["doc_id"]][0].replace(pieces.MARK, " ") for r in out)
    assert pieces.encode_column(empty(spark)).count() == 0


def hand_made_model(kind=1, fallback=True, user=(), unused=(), squeeze=False, normal=None):
    """The protobuf of a small model."""
    import struct

    def field(n, wire, payload):
        size = bytes([len(payload)]) if wire == 2 and len(payload) < 128 else b""
        return bytes([n << 3 | wire]) + size + payload

    def piece(text, score, what):
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([what]))
        return field(1, 2, body)

    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    data += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) if fallback else b""
    for k, p in enumerate(normal or ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "bab", "c", "<", ">", "s", "0", "x", "4", "1"]):
        data += piece(p, -1.0 - 0.37 * k, 1)
    data += b"".join(piece(p, 0.0, 4) for p in user) + b"".join(piece(p, -0.5 - 0.01 * k, 5) for k, p in enumerate(unused))
    trainer = field(3, 0, bytes([kind])) + bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7]) + bytes([fallback])
    rules = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, bytes([squeeze])) + field(5, 0, b"\x01")
    return data + field(2, 2, trainer) + field(3, 2, rules)


ODD_PIECES = ["ab", "abab ba", "c  ab", "", "babab cab é", "a b", "<s>", "a<s>b </s>", "<0x41>", "<unk> a", "abc", "xabcx", "é日<0x41>é", "  a  ", "a\u2581b", "<sep>", "a<sep>b <sep><sep> c", "\n\t\x00", "zzz", "🙂🙂a"]


@pytest.mark.parametrize("how", [{}, {"fallback": False}, {"unused": ("abc", "xabcx")}, {"user": ("<sep>",)}, {"user": ("<sep>", "▁c"), "unused": ("abc",), "fallback": False}, {"squeeze": True, "user": ("<sep>",)}])
def test_unigram_model_is_rebuilt(how):
    """Hand-made unigram protobufs, against the sentencepiece library: control, byte and unused pieces stand in no text."""
    import sentencepiece

    data = hand_made_model(**how)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data)
    assert codec.model.kind == 1 and codec.model.byte_fallback == how.get("fallback", True)
    rng = random.Random(5)
    for t in ODD_PIECES + ["".join(rng.choice("ab c<s>x041é") for _ in range(rng.randrange(30))) for _ in range(300)]:
        ids, _, agrees = codec.encode([t])
        assert ids.tolist() == sp.encode(t), t
        assert agrees[0] or codec.by_word, t
        assert codec.decode([ids.tolist()])[0] == sp.decode(ids.tolist()), t


@pytest.mark.parametrize("how", [{}, {"unused": ("bab", "xab")}, {"user": ("<sep>",)}])
def test_bpe_model_is_rebuilt(how):
    import sentencepiece

    normal = ["ab", "▁a", "▁ab", "ba", "xa", "a", "b", "c", "x", "▁", "<", ">", "s", "e", "p", "0", "4", "1"]
    data = hand_made_model(kind=2, normal=normal, **how)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data)
    rng = random.Random(6)
    for t in ODD_PIECES + ["".join(rng.choice("ab cx") for _ in range(rng.randrange(30))) for _ in range(300)]:
        assert codec.encode([t])[0].tolist() == sp.encode(t), t


def test_known_words_are_bounded_by_their_bytes():
    codec = pieces.Codec(open(pieces.MODEL, "rb").read(), held_bytes=1000)
    for k in range(20):
        ids, _, fine = codec.encode([f"{k}" * 300])
        assert fine.all() and codec.known_bytes <= 1000 + 600


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "big" if i % 3 else f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes)
    n = np.array([sizes[s] for s in names], float)
    x = mixing.exponent(n, 0.95 * np.log(len(n)), 4.0, n.sum())
    w = mixing.weights(n, x)
    assert abs(mixing.entropy(w) - 0.95 * np.log(len(n))) < 1e-6 or mixing.passes(n, w, n.sum()).max() <= 4 + 1e-6
    out = rows_of(mixing.mix(df, entropy_share=0.95, range_rows=16))
    text = {i: len(t.split()) for i, t, _ in rows}
    for s, weight in zip(names, w, strict=True):
        mine = [r for r in out if r["source"] == s]
        budget = weight * n.sum()
        took = sum(r["n_tokens"] for r in mine)
        assert budget - 7 < took <= budget + 1e-6
        blocks = defaultdict(list)
        for r in mine:
            assert r["n_tokens"] == text[r["doc_id"]] and abs(r["weight"] - weight) < 1e-12
            blocks[r["block"]].append(r)
        for b, members in blocks.items():
            members.sort(key=lambda r: r["position"])
            assert [r["position"] for r in members] == list(range(len(members)))
            at = 0
            for r in members:
                assert r["tokens_before"] == at
                at += r["n_tokens"]
            assert len({r["doc_id"] for r in members}) == len(members)
            if b < max(blocks):
                assert {r["doc_id"] for r in members} == {i for i, _, q in rows if q == s}
    again = rows_of(mixing.mix(df, entropy_share=0.95, range_rows=100))
    order = lambda rs: sorted((r["source"], r["block"], r["position"], r["doc_id"]) for r in rs)
    assert order(out) == order(again)  # the ranges don't show
    assert mixing.mix(empty(spark)).count() == 0
    odd = rows_of(mixing.mix(docs(spark), entropy_share=None, budget=None, max_passes=1.5))
    assert {key(r["doc_id"]) for r in odd} == {key(r["doc_id"]) for r in docs(spark).collect()}


def test_exponent_limits():
    n = np.array([1000.0, 100.0, 10.0])
    assert mixing.exponent(n) == 1.0
    x = mixing.exponent(n, max_passes=2.0, budget=None)
    assert mixing.passes(n, mixing.weights(n, x), None).max() == pytest.approx(2.0)
    assert mixing.passes(n, mixing.weights(n, x), None).min() == pytest.approx(1.0)


def test_license_scan(spark):
    filler = texts(9, 12)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rng = random.Random(5)
    rows = []
    for k, t in enumerate(notices):
        words = t.split()
        if len(words) > 12:
            words[0] = "changed"
        rows.append(f"{filler[k % 12] or ''} {' '.join(words)} {filler[(k + 5) % 12] or ''}")
    rows += [None, "", "license", "Released under the", *filler, " ".join(w for t in notices for w in t.split())]
    rng.shuffle(rows)
    index = licenses.Index()
    df = docs(spark, rows)
    out = rows_of(licenses.scan_licenses(df))
    want = set()
    for r in df.collect():
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        for k, t in enumerate(notices):
            v = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
            mine = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
            c = 1 << max(3, int(np.ceil(np.log2(len(v)))))
            for s in range(0, max(len(w), 1), c):
                have = {tuple(w[i : i + 5]) for i in range(s, min(s + 2 * c, len(w)) - 4)}
                if len(mine & have) >= index.need(k):
                    want.add((r["doc_id"], k))
    assert {(r["doc_id"], r["template"]) for r in out} == want
    assert len(want) >= len(notices)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_url_rules_and_trees(spark):
    urls = ["http://a.net/x", "https://A.Example.NET/en/1", "http://example.net/en", "http://example.net", "https://x.example.com/de/1?x=1", "https://example.com/fr/1", "ftp://q.org/fr/", "http://notorg/fr/x", "no scheme", None, "", "http://x.org?fr/", "HTTP://ORG/fr/#z", "http://a://b.net/", "http://xnet/"]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, suffix string, bad int")
    model = url_filter.Trees().fit(np.zeros((0, len(url_filter.NAMES))), np.zeros(0))
    out = {r["page_id"]: r.asDict() for r in url_filter.judge(pages, model, np.zeros((url_filter.FOLDS, url_filter.BUCKETS, 3))).collect()}
    for i, u in enumerate(urls):
        head, sep, rest = (u or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if sep else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
        host = host.lower()
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_filter.judge(pages.limit(0), model, np.zeros((url_filter.FOLDS, url_filter.BUCKETS, 3))).count() == 0


def test_trees_learn_from_urls(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        host = f"{''.join(rng.choices('0123456789' if bad else 'abcdef', k=12))}.{'xyz' if bad and rng.random() < 0.7 else 'com'}"
        query = "?" + "&".join(f"p{k}={rng.random()}" for k in range(rng.randrange(2, 6))) if bad else ""
        rows.append((i, f"http://{host}/{'a/' * rng.randrange(4)}{query}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model, stats = url_filter.fit_filter(df.select("page_id", "url"), df.where("page_id % 2 = 0").select("page_id", "bad"))
    got = url_filter.judge(df.where("page_id % 2 = 1"), model, stats, rules=()).join(df, "page_id").toPandas()
    assert ((got["verdict"] == "block") == (got["bad"] == 1)).mean() > 0.97


def slow_trees(x, y, trees, depth, rate, bins, ridge, least):
    """Boosting by trying each feature and each of its cuts at every node; a function from a row to its log-odds."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]
    base = float(np.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1))))
    margin, grown = [base] * len(y), []

    def grow(rows, level, g, h):
        G, H = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = (1e-9, None, None)
        if level < depth:
            for k in range(x.shape[1]):
                for c in cuts[k]:
                    left = [r for r in rows if x[r, k] <= c]
                    gl, hl = sum(g[r] for r in left), sum(h[r] for r in left)
                    if hl < least or H - hl < least:
                        continue
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, k, c)
        if best[1] is None:
            return rate * G / (H + ridge)
        _, k, c = best
        return k, c, grow([r for r in rows if x[r, k] <= c], level + 1, g, h), grow([r for r in rows if x[r, k] > c], level + 1, g, h)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        grown.append(grow(range(len(y)), 0, [a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p]))
        margin = [m + walk(grown[-1], row) for m, row in zip(margin, x, strict=True)]
    return lambda row: base + sum(walk(t, row) for t in grown)


def test_trees_against_a_slow_version():
    rng = np.random.RandomState(4)
    x = np.c_[rng.rand(150), rng.randint(0, 4, 150), rng.rand(150)]
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 1) ^ (rng.rand(150) < 0.1)).astype(float)
    fast = url_filter.Trees(6, 3, 0.2, 8, 10.0, 1.0).fit(x, y)
    slow = slow_trees(x, y, 6, 3, 0.2, 8, 1.0, 1.0)
    assert np.allclose([slow(r) for r in x], list(fast.margins(x))[-1])
    # noise alone grows no tree that serves rows held back
    noise = url_filter.Trees(30).fit(x, rng.randint(0, 2, 150).astype(float), np.arange(150) % 3 == 0)
    assert len(noise.trees) <= 3


def test_url_query_and_odd_rows(spark, tmp_path):
    """No URL meets its own label; nulls, repeats, long URLs, clashing names and empty tables have rows and don't break one."""
    rng = random.Random(9)
    rows = [(i, f"https://h{rng.randrange(40)}.{rng.choice(['com', 'org', 'xyz'])}/{rng.choice(['en', 'fr'])}/{i}.html") for i in range(300)]
    odd = [(None, "http://a.com/1"), (5, "http://b.com/5"), (5, "http://b.com/5"), (900, None), (901, ""), (902, "http://x.com/" + "a" * 100_000), (903, "http://é.com/ü?ß=1")]
    pages = spark.createDataFrame([(*r, "h", 1, 0) for r in rows + odd], "page_id long, url string, html string, fold int, bad int")
    labels = [(i, rng.randrange(2), None) for i in range(200)] + [(3, 0, 1), (None, 1, 1), (700, None, 1)]
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = rows_of(url_filter.op3_url_trees(spark, str(tmp_path)))
    assert sorted(map(str, (r["page_id"] for r in out))) == sorted(str(r[0]) for r in rows + odd)
    assert all(0 <= r["score"] <= 1 and r["verdict"] in ("allow", "block") for r in out)
    # the rates of a fold don't change with the labels inside it
    of = {r["page_id"]: r["fold"] for r in url_filter._with_buckets(pages, "page_id", "url").where("page_id < 200").collect()}
    lab = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - b if of[i] == 2 else b) for i, b in lab]
    first, second = (url_filter.fit_filter(pages, spark.createDataFrame(x, "page_id long, bad int"))[1] for x in (lab, turned))
    assert np.allclose(first[2], second[2]) and not np.allclose(first[1], second[1])
    none = url_filter.fit_filter(pages, spark.createDataFrame([], "page_id long, bad int"))
    assert url_filter.judge(pages, *none).where("rule is null and verdict = 'block'").count() == 0
    none = url_filter.fit_filter(pages.limit(0), spark.createDataFrame([], "page_id long, bad int"))
    assert url_filter.judge(pages.limit(0), *none).count() == 0


class SlowKneserNey:
    """Interpolated Kneser-Ney over dictionaries: counts at order 6, numbers of bytes seen before below; orders 1 to 3 from both classes."""

    def __init__(self, words):
        self.full = {c: defaultdict(int) for c in (0, 1)}
        for c, w in words:
            s = b"\x02" * 5 + w + b"\x03"
            for k in range(len(s) - 5):
                self.full[c][s[k : k + 6]] += 1
        self.tables = {}
        for c in (0, 1):
            every = set(self.full[0]) | set(self.full[1])
            for n in range(1, 6):
                seen = every if n <= 3 else set(self.full[c])
                wide = {g[-n - 1 :] for g in seen}
                self.tables[c, n] = defaultdict(int)
                for g in wide:
                    self.tables[c, n][g[1:]] += 1
            self.tables[c, 6] = self.full[c]
        self.totals = {k: self._by_context(t) for k, t in self.tables.items()}

    @staticmethod
    def _by_context(table):
        out = defaultdict(lambda: [0, 0])
        for g, v in table.items():
            out[g[:-1]][0] += v
            out[g[:-1]][1] += 1
        return out

    def p(self, c, gram):
        below = 1 / 256
        for n in range(1, 7):
            g = gram[-n:]
            total, kinds = self.totals[c, n].get(g[:-1], (0, 0))
            if total:
                below = max(self.tables[c, n].get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * below
        return below


def test_kneser_ney_against_a_slow_version():
    rng = random.Random(12)
    words = [(rng.randrange(2), "".join(rng.choices("abcé", k=rng.randrange(1, 9))).encode()) for _ in range(300)]
    slow, found = SlowKneserNey(words), {c: defaultdict(int) for c in (0, 1)}
    for c in (0, 1):
        from docloom.llm._words import Words
        import pyarrow as pa

        text = pa.array([b" ".join(w for k, w in words if k == c).decode()])
        ws = Words(text)
        for g in toxicity._grams(ws, np.arange(len(ws.starts)))[0].tolist():
            found[c][g] += 1
    grams = sorted(set(found[0]) | set(found[1]))
    # column 0 is toxic
    model = toxicity.KneserNey(np.array(grams, np.uint64), np.array([[found[1][g], found[0][g]] for g in grams]))
    asked = [bytes(rng.choices(b"\x02abc\x03", k=6)) for _ in range(200)] + list(slow.full[0])[:100]
    toxic, plain = model.likelihoods(np.array([int.from_bytes(a, "big") for a in asked], np.uint64))
    assert np.allclose(np.exp(toxic), [slow.p(1, a) for a in asked]) and np.allclose(np.exp(plain), [slow.p(0, a) for a in asked])


def test_toxicity_of_odd_rows(spark):
    """Clashing names, long texts, repeated rows and labels: a row each, and of repeated labels the greatest counts."""
    rng = random.Random(13)
    rows = [(i, " ".join(["foulbrute" if i % 4 == 0 and k % 5 == 0 else rng.choice(WORDS) for k in range(40)]), 1, "f", True, 0.5) for i in range(300)]
    rows += [(500, "bar " * 200_000, 1, "f", True, 0.5), (500, "bar " * 200_000, 1, "f", True, 0.5), (501, "foulbrute " * 20_000, 0, "f", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold string, held_out boolean, score double")
    once = [(i, int(i % 4 == 0)) for i in range(300)]
    lab = lambda more: spark.createDataFrame(once + more, "doc_id long, toxic int").withColumn("fold", F.lit("x"))
    out, again = (rows_of(toxicity.score(df, *toxicity.train(df, lab(more)))) for more in ([], [(i, 0) for i in range(300)] + once[:9]))
    order = lambda rs: sorted((r["doc_id"], r["score"]) for r in rs)
    assert len(out) == len(rows) and order(out) == order(again)
    assert {r["predicted"] for r in out if r["doc_id"] == 501} == {1} and {r["predicted"] for r in out if r["doc_id"] == 500} == {0}


def test_toxicity(spark):
    rng = random.Random(6)
    rude = ["vilewretch", "foulbrute", "scornfool"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.choice([5, 40, 200]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "x"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = rows_of(toxicity.score(df, *toxicity.train(df, lab)))
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    # held-out labels teach nothing
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    other = rows_of(toxicity.score(df, *toxicity.train(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))))
    order = lambda rs: sorted((key(r["doc_id"]), r["score"]) for r in rs)
    assert order(other) == order(out)
    none = rows_of(toxicity.score(df.limit(3), *toxicity.train(df.limit(0), lab.limit(0))))
    assert len(none) == 3 and all(0 <= r["score"] <= 1 for r in none)


def test_kneser_ney_sums_to_one():
    rng = np.random.RandomState(0)
    grams = np.unique(rng.randint(97, 103, (400, 6)).astype(np.uint64) @ (np.uint64(1) << (np.arange(5, -1, -1).astype(np.uint64) * np.uint64(8))))
    model = toxicity.KneserNey(grams, rng.randint(0, 4, (len(grams), 2)) + 1)
    for context in grams[:20] >> np.uint64(8):
        q = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        for like in model.likelihoods(q):
            assert np.exp(like).sum() == pytest.approx(1.0, abs=1e-9)


def test_language(spark):
    rng = random.Random(7)
    vocab = {"en": ["the", "thing", "ther", "ing", "shon"], "fr": ["eau", "eaux", "ment", "que", "étion"], "de": ["sch", "ung", "keit", "über", "der"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.choice([1, 4, 60]))), lang if i % 2 else None, f"s{i % 5}", 1) for i, lang in enumerate(rng.choices(list(vocab), k=400))]
    truth = {i: next(x for x, ws in vocab.items() if t.split()[0] in ws) for i, t, *_ in rows}
    rows += [(400, None, "en", None, 0), (401, "", "fr", "s1", 0), (402, "12 34 !?", "de", "s1", 0), (None, "the thing ther", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.org/{truth[i]}/{i}", f'<html lang="{truth[i]}">') for i in range(0, 400, 3)] + [(9000, None, None), (9001, "x", "")], "page_id long, url string, html string")
    for p in (pages, None):
        out = rows_of(language.identify(df, p))
        assert len(out) == len(rows)
        assert np.mean([r["language"] == truth[r["doc_id"]] for r in out if r["doc_id"] is not None and r["doc_id"] < 400]) > 0.99
        assert {r["doc_id"] for r in out if not r["accepted"]} == {400, 401, 402}
    assert language.identify(df.limit(0), pages).count() == 0
    assert all(r["language"] == "und" for r in rows_of(language.identify(df.withColumn("lang", F.lit(None).cast("string")), None)))


def test_language_against_a_slow_version(spark):
    """Posteriors by hand, with several pages to a document, clashing names, repeated rows, null ids and a long text."""
    import math

    rng = random.Random(17)
    vocab = {"en": ["the", "thing", "ther", "shon"], "fr": ["eaux", "ment", "que", "etion"], "de": ["sch", "ung", "keit", "der"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.choice([1, 2, 30]))), lang, rng.choice(["s1", "s2", None])) for i, lang in enumerate(rng.choices(list(vocab), k=60))]
    rows += [rows[0], (None, "the que", "en", "s1"), (60, "ung der " * 40_000, "de", "s2"), (61, "", "de", "s2")]
    pages = [(k, f"https://h{rng.randrange(4)}.e{rng.randrange(2)}.{rng.choice(['org', 'fr'])}/{rng.choice(['en', 'fr', 'xx'])}/{rng.randrange(25)}.html", f"<html lang='{rng.choice(['en', 'fr', 'zz'])}'>") for k in range(45)]
    df = spark.createDataFrame([(*r, "like", 1, "h", True, "r") for r in rows], "doc_id long, text string, lang string, source string, like string, __id int, host string, letters boolean, row string")
    out = rows_of(language.identify(df, spark.createDataFrame(pages, "page_id long, url string, html string"), keep=("like", "row")))
    langs, model = language.train(df, "text", "lang", "doc_id")
    known = language.known_grams(model)
    soft = lambda v: (lambda e: e / e.sum())(np.exp(v - v.max()))
    texts_ = []
    for i, t, _, source in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        code, ok = language._grams(data, np.array([0, len(data)]))
        code = code[ok] if len(code) else code
        ll = model[:, code].astype(float).sum(1) * language.TEMPER if len(code) else np.zeros(len(langs))
        chance = min(max(known.mean(), 1e-6), language.SEEN - 0.05)
        n, k = len(code), int(known[code].sum()) if len(code) else 0
        odd = (k * math.log(chance / language.SEEN) + (n - k) * math.log((1 - chance) / (1 - language.SEEN))) * language.TEMPER + math.log(language.NONE)
        mine = []
        for _, url, html in pages:
            m = re.match(r"https://([^/]*)/([a-z]{2})/([0-9]+)\.html", url)
            if i is not None and int(m[3]) == i:
                mine.append((m[1], m[1].rsplit(".", 1)[1] + "|" + m[2], re.search("'(..)'", html)[1]))
        texts_.append((i, ll, soft(ll), bool(re.search("[a-z]", t or "")) and odd <= 0, [(source or "", "", "")] if not mine else mine))
    site = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    sums = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(3)]
    for _, _, post, fits, seen in texts_:
        for h, x, _ in seen:
            for table, k in zip(sums, (h, site(h), x), strict=True):
                table[k] += post / len(seen) * fits
    every = sum((post for _, _, post, fits, _ in texts_ if fits), np.zeros(len(langs)))
    base = (every + 1) / (every.sum() + len(langs))
    want = []
    for i, ll, post, fits, seen in texts_:
        told = np.zeros(len(langs))
        for h, x, said in seen:
            own = post / len(seen) * fits
            hs, ss, xs = (np.maximum(t[k] - own, 0) for t, k in zip(sums, (h, site(h), x), strict=True))
            smooth = lambda v, q: (v + language.STRENGTH * q) / (v.sum() + language.STRENGTH)
            one = np.log(smooth(hs, smooth(ss, base))) + (np.log(smooth(xs, base) / base) if x else 0)
            if said in langs:
                one = one + np.log([language.TRUST if a == said else (1 - language.TRUST) / (len(langs) - 1) for a in langs])
            told += one / len(seen)
        p = soft(ll + told)
        want.append((key(i), langs[int(p.argmax())] if fits else "und", p.max(), fits))
    got = sorted((key(r["doc_id"]), r["language"], r["posterior"], r["accepted"]) for r in out)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert np.allclose([c for _, _, c, _ in got], [c for _, _, c, _ in sorted(want)], atol=2e-6)
    assert all(r["host"] is not None for r in out) and {r["like"] for r in out} == {"like"}


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: each group of equal texts, and of near ones, keeps one row; a rejected row doesn't take others of its id along."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = [(5, "alpha beta"), (None, "alpha  beta"), (None, "unique"), (7, "alpha beta"), (7, "other"), (7, "other"), (None, "12 34"), (8, "12"), (8, "some words"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "a", k // 9) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    texts_of = lambda d: sorted(((key(r["doc_id"]), r["text"]) for r in d.collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)
    assert texts_of(stage["language ID"](spark, df, str(tmp_path))) == sorted([(key(i), t) for i, t in rows if re.search("[a-z]", t or "")], key=str)
    assert [t for _, t in texts_of(stage["exact dedup"](spark, df, str(tmp_path)))].count("other") == 1
    kept = texts_of(stage["exact dedup"](spark, df, str(tmp_path)))
    assert kept == sorted([(5, "alpha beta"), (key(None), "unique"), (7, "other"), (key(None), "12 34"), (8, "12"), (8, "some words"), (9, kept_null(kept))], key=str)
    near = texts_of(stage["near dedup"](spark, df, str(tmp_path)))
    prints = defaultdict(list)
    for i, t in rows:
        prints[slow_fingerprint(t)].append(key(i))
    assert sorted(i for i, _ in near) == sorted(min(v) for v in prints.values()) and len({slow_fingerprint(t) for _, t in near}) == len(near)
    mixed = stage["source mixing"](spark, df, str(tmp_path)).collect()
    assert sorted(map(str, mixed)) == sorted(str(r) for r in df.collect())
    blank = df.limit(0)
    assert all(run(spark, blank, str(tmp_path)).count() == 0 for _, run in corpus_pipeline.STAGES)


def kept_null(kept):
    """Null and empty texts of one id are one group; either may stay."""
    return next(t for i, t in kept if i == 9)


def test_mixture_comes_in_order(spark, tmp_path):
    """The rows of the stage, read in order: every prefix has the sources at their weights, every whole block holds its source once."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "big" if i % 10 else "small", "en", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = corpus_pipeline.source_mix(spark, df, "").collect()
    share = lambda rs: sum(len(r["text"].split()) for r in rs if r["source"] == "small") / sum(len(r["text"].split()) for r in rs)
    assert len(out) > len(rows) and {r["doc_id"] for r in out} == set(range(2000))
    assert all(abs(share(out[:k]) - share(out)) < 0.03 for k in (400, 800, 1200, 1600))
    small = [r["doc_id"] for r in out if r["source"] == "small"]
    assert sorted(small[:200]) == list(range(0, 2000, 10)) != small[:200]


def test_distinct_texts(spark):
    df = docs(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best = {}
    for r in df.collect():
        n = norm(r["text"])
        best[n] = min(best.get(n, key(None)), key(r["doc_id"]))
    out = exact_dedup.distinct_texts(df)
    assert out.columns == df.columns
    assert sorted((norm(r["text"]), key(r["doc_id"])) for r in out.collect()) == sorted(best.items())
    assert exact_dedup.distinct_texts(empty(spark)).count() == 0


@pytest.mark.parametrize("ranges", [2, 9, 40])
def test_splitters_part_long_common_starts(spark, ranges):
    """Texts that share a long start, and one text with half of the rows: no range has much more than its share."""
    rng = random.Random(ranges)
    rows = [(i, "same text " * 30 if i % 2 else "common start " * 20 + "".join(rng.choices("abcdef", k=8))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = exact_dedup.splitters(df, ranges, sampled=400)
    assert cuts == sorted(cuts) and len(cuts) == ranges - 1
    sizes = np.bincount([sum(c <= (exact_dedup.normalise(t.encode()), i) for c in cuts) for i, t in rows], minlength=ranges)
    assert sizes.max() < 2.2 * len(rows) / ranges


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from docloom.llm import _base

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _base.shared_dir(Session())
    assert [_base.bytes_of(x) for x in ("4m", "8388608b", "1g", "-1", "x", "12")] == [4 << 20, 8 << 20, 1 << 30, 0, 0, 12]


def test_nothing_is_left_in_the_shared_folder(spark):
    import os
    from urllib.parse import urlparse

    from docloom.llm import _base

    out = simhash.near_duplicates(docs(spark))
    assert out.count() == docs(spark).count()
    at = urlparse(_base.shared_dir(spark)).path + "/docloom"
    assert os.listdir(at)
    _base.clean()
    assert not os.listdir(at)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    at = df
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == list(corpus_pipeline.COLUMNS)
            at.write.parquet(str(tmp_path / f"{k}"))
            at = spark.read.parquet(str(tmp_path / f"{k}"))
            kept = {key(r["doc_id"]) for r in at.collect()}
            if k == 0:
                assert kept == {key(r["doc_id"]) for r in before if re.search(r"[a-z\u0080-\U0010ffff]", (r["text"] or "").lower())}
            if k == 1:
                groups = defaultdict(list)
                for r in before:
                    groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(key(r["doc_id"]))
                assert kept == {min(g) for g in groups.values()} and at.count() == len(kept)
            if k == 3:
                assert kept == {key(r["doc_id"]) for r in before} and at.count() >= len(before)
    assert at.where("n_tokens = 0").count() == 0 and at.where("not agrees").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_license_texts_paragraphs_and_notices(spark, tmp_path):
    """The registered scan knows whole texts, paragraphs without the telling sentence, and versions of short notices."""
    from docloom.llm import queries

    full, filler = licenses.full_texts(), "mot de plus " * 60
    pick = lambda n, start: next(t for t in full[n] if t.lstrip().startswith(start))
    rows = {
        "MIT": pick("MIT", "THE SOFTWARE IS PROVIDED"), "BSD-3-Clause": full["BSD-3-Clause"][0], "BSD-2-Clause": full["BSD-2-Clause"][0], "Apache-2.0": full["Apache-2.0"][0], "GPL-2.0": full["GPL-2.0"][0], "LGPL-2.1": full["LGPL-2.1"][0], "CC0-1.0": full["CC0-1.0"][0],
        "GPL-3.0": "released under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "EPL-2.0": "made available under the Eclipse Public License v2.0", "AGPL-3.0": "This file is under AGPL-3.0 terms", "CC-BY-NC-4.0": "shared under CC BY-NC 4.0 by us", "All-rights-reserved": "All rights reserved.",
    }
    extra = {"v2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "none": "a General license, version 3", "other": "Licensed under the Acme License, Version 2.0."}
    names = [*rows, *extra]
    data = [(i, f"{filler}{t} {filler}") for i, t in enumerate([*rows.values(), *extra.values()])]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in rows_of(queries.QUERIES["op4_license_windows"](spark, str(tmp_path))):
        got.setdefault(names[r["doc_id"]], set()).add(r["license"])
    assert {n: n in got.get(n, ()) for n in rows} == dict.fromkeys(rows, True)
    assert {n: got[n] for n in ("BSD-3-Clause", "BSD-2-Clause", "GPL-2.0", "Apache-2.0")} == {n: {n} for n in ("BSD-3-Clause", "BSD-2-Clause", "GPL-2.0", "Apache-2.0")}
    assert "GPL-2.0" in got["v2"] and "GPL-3.0" not in got["v2"] and "none" not in got and "other" not in got


def test_language_takes_all_labels_and_rejects_what_fits_none(spark):
    rng = random.Random(11)
    vocab = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(40)}
    rows = [(100 * k + i, " ".join(rng.choices(vocab[lang], k=30)), lang) for k, lang in enumerate(vocab) for i in range(3 if k >= 30 else 12)]
    odd = [(9001, "\U0001f600 ☃ → € —"), (9002, "漢字は日本語の文字である" * 5), (9003, "12 … !")]
    df = spark.createDataFrame([(i, t, lang, f"s{i % 3}") for i, t, lang in rows] + [(i, t, None, "s0") for i, t in odd], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in rows_of(language.identify(df, None, sample=300))}
    assert {i: out[i]["language"] for i, _, _ in rows} == {i: lang for i, _, lang in rows}
    assert {out[i]["language"] for i, _ in odd} == {"und"} and not any(out[i]["accepted"] for i, _ in odd)
