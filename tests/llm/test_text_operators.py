"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.llm import bpe, common, exact_dedup, html_extract, lm, mixing, near_copies, quality, simhash, suffix_dedup, token_io
from nodeloom.llm.common import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, component string, row_no int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, None, "x", 1, "k") for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "wood", "Stone,", "river", "Ünder", "a", "\n", "sky.", "42"]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    long = words(rng, 4000)
    shared = words(rng, 60)
    rows = [(i, words(rng, rng.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s0"), (102, " \t\n", "s1"), (103, long, "s2"), (104, long[:9000] + "x" + long[9001:], "s2")]
    rows += [(110 + i, shared + f" tail {i} " + words(rng, 30), "s3") for i in range(6)]
    rows += [(120 + i, "same  text\nhere", "s0") for i in range(9)] + [(130, "same text here", None)]
    rows += [(140, "twice", "s1"), (140, "twice", "s1"), (None, "no id", "s1"), (None, "twice", "s2"), (141, "ab" * 700, "s2"), (142, "no-break\tx\r\n  end", "s0")]
    return rows


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def normal(text):
    out, space = [], False
    for c in text or "":
        white = c == " " or "\t" <= c <= "\r"
        if not (white and space):
            out.append(" " if white else c)
        space = white
    return "".join(out)


def test_exact_dedup_matches_plain(spark, texts):
    groups = collections.defaultdict(list)
    for i, t, _ in texts:
        groups[normal(t)].append(i)
    got = exact_dedup.exact_dedup(frame(spark, texts), support=0.02).collect()
    assert len(got) == len(texts)
    for r in got:
        same = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(same)
        assert r["keep_id"] == min((i for i in same if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_drops_copies_only(spark, texts):
    kept = exact_dedup.drop_exact_copies(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert collections.Counter(normal(r["text"]) for r in kept.collect()) == collections.Counter({normal(t) for _, t, _ in texts})


def plain_fingerprint(text, k=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    group = {n: n for n in nodes}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in linked:
        group[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash_matches_plain(spark, texts):
    prints = [plain_fingerprint(t) for _, t, _ in texts]
    roots = closure(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = collections.defaultdict(list)
    for n, r in roots.items():
        if texts[n][0] is not None:
            least[r].append(texts[n][0])
    expected = sorted(((t[0], f"{prints[n]:016x}", min(least[roots[n]], default=None)) for n, t in enumerate(texts)), key=repr)
    assert collect(simhash.simhash_components(frame(spark, texts)), "doc_id", "fingerprint", "component_id") == expected


@pytest.mark.parametrize(("bucket", "bits"), [(128, 2), (2, 2), (2, 1), (3, 3)])
def test_links_find_every_pair_in_small_and_split_buckets(spark, monkeypatch, bucket, bits):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    found = {0, 1, 3, 7, 2**31, 2**32 + 1}
    for s in seeds.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            found.add(int(np.int64(s) ^ np.array([sum(1 << int(f) for f in flips)], dtype=np.uint64).view(np.int64)[0]))
    nodes = sorted(found)
    near = {(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    got = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long"), bits).collect()
    assert {(r["a"], r["b"]) for r in got} == near and len(got) == len(near)


def test_suffix_dedup_matches_brute_force(spark, texts):
    length = 40
    rng = random.Random(8)
    rows = texts + [(200 + i, words(rng, 8) + " " + "the passage of the many that all of them share " + words(rng, 8), "s") for i in range(12)]
    raw = [(t or "").encode() for _, t, _ in rows]
    counts = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    expected = []
    for (doc_id, _, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    for crowd in (50_000, 2):
        got = suffix_dedup.repeated_spans(frame(spark, rows), length=length, seed=12, crowd=crowd)
        assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_suffix_anchor_is_chosen_by_the_string_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes()
    first, last, place, seeds = suffix_dedup.anchors(data + data[5000:9000])
    assert first[0] == 0 and last[-1] == len(data) + 4000 - 200 and (first[1:] == last[:-1] + 1).all()
    of = {}
    for a, b, p, s in zip(first.tolist(), last.tolist(), place.tolist(), seeds.tolist(), strict=True):
        for start in range(a, b + 1):
            of[start] = (p - start, s)
    assert all(of[len(data) + i] == of[5000 + i] for i in range(3800))


@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=2, max_size=9, unique=True))
@settings(max_examples=300, deadline=None)
def test_interval_scan_finds_every_shared_string(parts):
    length = 8
    contexts = list({(a + "SSS" + b): (f"{a}SSS{b}".encode(), len(a)) for a, b in parts if len(a) + len(b) + 3 >= length}.values())
    if len(contexts) < 2:
        return
    found = suffix_dedup.repeated_starts(contexts, length)
    for (text, at), runs in zip(contexts, found, strict=True):
        got = {s for a, b in runs for s in range(a, b + 1)}
        want = set()
        for s in range(len(text) - length + 1):
            if s <= at and at + 3 <= s + length:
                others = [o[p - (at - s) : p - (at - s) + length] for o, p in contexts if o != text and p >= at - s]
                if text[s : s + length] in others:
                    want.add(s)
        assert {s for s in got if s <= at and at + 3 <= s + length} == want
        assert all(any(text[s : s + length] in o for o, _ in contexts if o != text) for s in got)


VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(VOCABULARY), special_tokens={})


@given(text=st.one_of(st.text(max_size=60), st.text("ab \n\t\r\x1c'slEé中1!", max_size=60)), block=st.integers(1, 7))
@settings(max_examples=500, deadline=None)
def test_bpe_equals_the_library_and_streams_back(own, library, text, block):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert "".join(own.decode_stream(ids, block)) == text


def test_bpe_streams_long_pieces(own, library):
    for piece in ("ab" * 900, "a" * 3000, "-" * 4000, "é" * 800):
        blocks = [piece.encode()[i : i + 37] for i in range(0, len(piece.encode()), 37)]
        parts = list(own.t.stream(blocks))
        assert sum(parts, []) == library.encode_ordinary(piece)
        assert own.t.encode(piece.encode()) == library.encode_ordinary(piece)
    assert len(list(own.t.stream([b"ab" * 400] * 9))) > 1
    held = []
    own.t._back, back = lambda ends, at: (held.append(len(ends)), back(ends, at))[1], own.t._back
    try:
        own.t.encode(b"ab" * 40_000)
    finally:
        del own.t._back
    assert max(held) <= 4 * bpe.LOOKAHEAD  # no more of a long piece is held than a lookahead and a block


def test_utf8_machine_replaces_like_python():
    rng = random.Random(2)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xE0]) for _ in range(rng.randint(0, 12)))
        machine, out, at = bpe.Utf8(), "", 0
        while at < len(data):
            step = rng.randint(1, 3)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_bpe_round_trip_query(spark, texts, library):
    expected = []
    for i, t, _ in texts:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert collect(bpe.round_trip(frame(spark, texts), path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    encoded = bpe.encode_documents(frame(spark, texts), path, pattern)
    assert encoded.where("NOT lossless").count() == 0
    back = bpe.decode_documents(encoded, path, pattern)
    assert collect(back, "doc_id", "text") == sorted(((i, t or "") for i, t, _ in texts), key=repr)


def test_token_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_io.token_files(frame(spark, texts), path).orderBy("start").collect()
    assert [r["doc_id"] is None for r in got] == sorted((r["doc_id"] is None for r in got), reverse=True)
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    at, seen = 0, collections.Counter()
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen[(r["doc_id"], r["n_tokens"], r["ids_crc32"])] += 1
    want = collections.Counter()
    for i, t, _ in texts:
        x = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[(i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()))] += 1
    assert seen == want


def test_token_files_keep_ids_and_refuse_damage(spark, texts):
    path = fresh_path(spark, "tokens")
    token_io.write_token_files(frame(spark, texts[:20]), public_tokenizers.path("byte_bpe_50k.json"), path)
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in token_io.read_token_files(spark, path, with_ids=True).collect())
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 300_000), 50_000).astype(np.uint32)
    coder = token_io.Rans(token_io.quantise(np.bincount(ids)))
    data = coder.encode(ids)
    assert (coder.decode(data) == ids).all()
    stride = token_io.LANES * token_io.STEPS
    for k in range(-(-300_000 // stride)):
        assert (coder.decode(data, k, True) == ids[k * stride : (k + 1) * stride]).all()
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(broken))


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "w " * int(rng.expovariate(0.02)), rng.choice(["b", "a", "ä", None])) for i in range(900)] + [(2000, None, "a"), (2001, "", "empty"), (2001, "", "empty")]
    first = mixing.mix(frame(spark, rows), block=50).collect()
    again = mixing.mix(frame(spark, rows).repartition(3), block=50).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    source = {i: s for i, _, s in rows}
    taken, target = collections.Counter(), {}
    for r in first:
        assert r["size"] == len((next(t for i, t, _ in rows if i == r["doc_id"]) or "").split())
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 3 for s, t in target.items())
    total = sum(r["size"] for r in first)
    assert sum(target.values()) == pytest.approx(total)


def plain_targets(sizes, weights=(1.0, 2.0, 3.0), limit=3.0):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, rest = {}, set(order)
    while rest:
        left, heavy = sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / heavy > limit * sizes[s]}
        out |= {s: limit * sizes[s] for s in over} if over else {s: left * weight[s] / heavy for s in rest}
        rest = rest - over if over else set()
    return out


@pytest.mark.parametrize("many", [2, 60])
def test_targets_stop_and_share_again(spark, many):
    rng = random.Random(many)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 4)) for i in range(many)} | {None: 90, "a": 0, "ä": 7}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())] + [(999, "a", 0)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, size long"), (1.0, 2.0, 3.0), 3.0, 10).collect()
    want = plain_targets(sizes)
    assert [r["source"] for r in sorted(got, key=lambda r: r["source_no"])] == sorted(s for s in sizes if s is not None) + [None]
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    empty = mixing.plan(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id long, source string, size long"), (1.0,), 3.0, 10)
    assert [r["target"] for r in empty.collect()] == [0, 0]


def test_flight_keeps_both_totals_and_probabilities():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 500, 40).astype(float)
    p = np.full(40, 0.3)
    hits = np.zeros(40)
    for k in range(400):
        moved = mixing.flight(p, size, iter(np.random.default_rng(k).random(200)))
        assert moved.sum() == pytest.approx(12, abs=1e-6) and moved @ size == pytest.approx(p @ size, abs=1e-4)
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        hits += moved
    assert np.abs(hits / 400 - 0.3).max() < 0.12


def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    good = [(i, words(rng, rng.randint(5, 200)), "s") for i in range(0, 400)]
    bad = [(i, " ".join(f"{w}***" for w in words(rng, rng.randint(5, 200)).split()), "s") for i in range(400, 600)]
    rows = good + bad + [(700, None, None), (701, "", "s"), (None, "the wood", "s"), (1, "the river", "s")]
    labels = spark.createDataFrame([(i, int(i < 400), "clash") for i in range(600)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    got = quality.fit_and_score(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and 1 < r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] < 400) for r in held) / len(held) > 0.95
    none = quality.fit_and_score(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert len(none) == 5 and all(0 <= r["score"] <= 1 for r in none)


def test_isotonic_steps_are_the_least_squares_fit():
    knots, means = quality.pool([(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 2, 2), (4, 1, 0)])
    assert knots.tolist() == [0, 0, 1, 2, 3, 4] and means.tolist() == pytest.approx([0, 0, 0.5, 0.5, 2 / 3, 2 / 3])


def test_lm_counts_and_scores(spark, texts):
    tokens = [(t or "").encode().lower().split() + [None] for _, t, _ in texts]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _, _ in texts]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    uni = collections.Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    got = lm.score_documents(frame(spark, texts), chunk_bytes=2000, owned=300).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    want = [(i, h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)) for (i, _, _), t, h in zip(texts, tokens, held, strict=True)]
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
        assert math.isfinite(g[6]) and g[6] < 0


def test_lm_is_a_distribution_and_does_not_depend_on_chunks(spark, texts, monkeypatch):
    weights = lm.learn_weights(np.array([3 << 20 | 8 << 10 | 40, 5 << 20 | 1023 << 10 | 30]), np.array([50, 70]), 100)
    assert weights.sum(axis=1) == pytest.approx(1) and weights[0, 0] == 0 and weights[5, 0] < 0.01 < weights[3, 0]
    a = collect(lm.score_documents(frame(spark, texts), chunk_bytes=500, owned=100), "doc_id", "score")
    b = collect(lm.score_documents(frame(spark, texts)), "doc_id", "score")
    assert [x[0] for x in a] == [x[0] for x in b] and sorted(x[1] for x in a) == pytest.approx(sorted(x[1] for x in b))


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body class="home header">
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies &amp; more</div>
<main><h1>A  title</h1><p>The first&nbsp;paragraph of the &quot;text&quot;<br>goes on</p><p>Short.<div class="ad">Buy!</div><p><a href="x">All of it a link</a></p>
<aside>Aside</aside><form>Name <input></form><p>1 &lt; 2</p></main><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_html_text():
    assert html_extract.main_text(PAGE) == 'A title\nThe first paragraph of the "text" goes on\nShort.\n1 < 2'
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p><!-- x") == ""
    assert html_extract.main_text("just  text < here") == "just text < here"
    prose = "It is the end of the road and there is no way to go on from it. " * 5
    bare = f"<body><div><a href=a>Menu one</a> <a href=b>two</a></div><h2>Head</h2><div>{prose}</div><div>Brief.</div><div>{prose}</div></body>"
    assert html_extract.main_text(bare).split("\n") == ["Head", prose.strip(), "Brief.", prose.strip()]


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, "c"), (3, "v", "x" * 200_000 + "<div" * 9, "c")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    "query",
    [
        lambda d: html_extract.extract(d.selectExpr("doc_id AS page_id", "text AS html", "source AS url", "lang", "key AS text")),
        lambda d: near_copies.near_components(d),
        lambda d: exact_dedup.exact_dedup(d),
        lambda d: simhash.simhash_components(d),
        lambda d: suffix_dedup.repeated_spans(d),
        lambda d: token_io.token_files(d, public_tokenizers.path("byte_bpe_50k.json")),
        lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        lambda d: mixing.mix(d),
        lambda d: mixing.mixed_documents(d),
        lambda d: quality.fit_and_score(d, d.selectExpr("doc_id", "1 AS quality")),
        lambda d: lm.score_documents(d),
    ],
)
def test_empty_tables_and_rows_of_nulls(spark, query):
    assert query(frame(spark, []).repartition(2)).count() == 0
    assert query(frame(spark, [(None, None, None)] * 3)).count() == 3


def test_quality_counts_upper_case_over_all_words():
    text = " ".join(["LOUD" if i % 2 else "quiet" for i in range(4096)])
    assert quality.statistics(text)[18] == pytest.approx(0.5)
    assert quality.statistics("x " * 3000 + "Y " + "x " * 3000)[18] == pytest.approx(1 / 6001)


@pytest.mark.parametrize("filling", ["<table>" + "<tr><td>cell" * 150 + "</table>", "<dl>" + "<dt>a<dd>b" * 150 + "</dl>", "<font>" * 300, "<b><span>x" * 300])
def test_html_closes_elements_at_any_depth(filling):
    prose = "It is the end of the road and there is no way to go on from it. " * 5
    assert html_extract.main_text(f"<body><nav>{filling}</nav><article><p>{prose}</p></article></body>") == prose.strip()


def test_html_ends_rows_and_terms_that_are_left_open():
    page = "<table><tr><td class=ad>Buy<td>the cell of it<tr><td>and the next</table><dl><dt class=ad>Buy<dd>it is the term</dl>"
    assert [b.text for b in html_extract.blocks(page)] == ["the cell of it", "and the next", "it is the term"]
    nested = "<table><tr><td class=ad><table><tr><td>in<tr><td>in</table>still in<td>out</table>"
    assert [b.text for b in html_extract.blocks(nested)] == ["out"]


def test_html_article_is_a_prior_only():
    prose = "It is the end of the road and there is no way to go on from it. " * 5
    cards = "<article><p>Teaser</p></article><article><p>Another</p></article>"
    assert prose.strip() in html_extract.main_text(f"<body>{cards}<div>{prose}</div><div>{prose}</div></body>").split("\n")
    source = "This is the source of the figures that are in the text and of all that is said on it"
    found = html_extract.main_text(f"<main><p>{prose}</p><p><a href=x>{source}</a></p><p>{prose}</p></main>")
    assert found.split("\n") == [prose.strip(), source, prose.strip()]
    menu = "".join(f"<p><a href=x>Menu {i}</a></p>" for i in range(3))
    assert html_extract.main_text(f"<main><p>{prose}</p>{menu}<p>Menu</p>{menu}</main>") == prose.strip()


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row_key string, _keep_id int, _sha string, good int, row int, times int, chosen int, copy int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "r", 1, "sha", 2, 3, 4, 5, 6) for i, t, s in rows], CLASH)


def test_row_filters_tell_repeated_ids_apart_and_keep_clashing_columns(spark):
    rng = random.Random(9)
    one, two, three = (words(rng, 60) for _ in range(3))
    rows = [(0, one, "a"), (1, one, "a"), (1, two, "a"), (2, three, "b"), (None, three, "b"), (None, words(rng, 50), "b")]
    df = clashing(spark, rows)
    for drop in (exact_dedup.drop_exact_copies, near_copies.drop_near_copies):
        got = drop(df)
        assert got.columns == df.columns
        assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter([(0, one), (1, two), (2, three), rows[5][:2]])
        unique = drop(clashing(spark, [(k, t, s) for k, (_, t, s) in enumerate(rows)]))
        assert unique.columns == df.columns and sorted(r["doc_id"] for r in unique.collect()) == [0, 2, 3, 5]
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    for some in (df, clashing(spark, [(k, t, s) for k, (_, t, s) in enumerate(rows)])):
        got = quality.keep_good(some, labels)
        assert got.columns == df.columns and got.count() == len(rows)


def test_mix_takes_rows_not_ids(spark):
    rng = random.Random(3)
    rows = [(7, words(rng, rng.randint(1, 40)), rng.choice("abc")) for _ in range(60)] + [(None, words(rng, 9), "a"), (None, "", "b")]
    df = clashing(spark, rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    size = lambda t: len((t or "").split())
    taken = mixing.mix(df).collect()
    assert sum(size(r["text"]) for r in got.collect()) == sum(r["taken"] for r in taken)
    assert len({r["text"] for r in got.collect() if r["text"]}) == sum(r["taken"] > 0 for r in taken)


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>\nb  c", "plain <|endoftex|> text"])
def test_token_files_follow_the_library_on_added_tokens(spark, text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [0]
    row = token_io.token_files(frame(spark, [(1, text, "s"), (2, "other words here", "s")]), path).where("doc_id = 1").first()
    assert (row["n_tokens"], row["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster())


PROSE = "It is the end of the road and there is no way to go on from it. " * 5


@pytest.mark.parametrize("unit", ["<a b", '<a b="', "<a b='", '<b ">"', "<a 'x\">", "<!--", "<![CDATA[", "<script ", "</p ", "< ", "<a href=x>", "<td><b>", "<p class='x"])
def test_html_reads_a_hostile_page_once(unit):
    began = time.perf_counter()
    page = unit * (1_000_000 // len(unit))
    html_extract.main_text(page)
    html_extract.main_text(page + '">')
    assert time.perf_counter() - began < 8


def test_html_open_quotes_and_tags_are_text_or_end_at_the_first_bracket():
    assert html_extract.main_text("<p>one</p><p title=\"x>two</p>") == "one\ntwo"
    assert html_extract.main_text("<p title='a > b'>in</p>") == "in"
    assert html_extract.main_text("a <b") == "a <b"


def test_html_second_pass_settles_short_blocks_without_an_article_element():
    menu = "<div><a href=a>Home</a></div><div><a href=b>News</a></div>"
    page = f"<body>{menu}<div>Menu note</div>{menu}<h2>Head</h2><div>{PROSE}</div><div>Brief.</div><div>{PROSE}</div>{menu}<div>Last</div>{menu}</body>"
    found = [(b.text, one, end) for b, one, end in html_extract.labelled(page)]
    assert [(t, end) for t, one, end in found if one == "short"] == [("Menu note", "bad"), ("Head", "good"), ("Brief.", "good"), ("Last", "bad")]
    assert html_extract.main_text(page).split("\n") == ["Head", PROSE.strip(), "Brief.", PROSE.strip()]


def test_html_second_pass_drops_short_junk_inside_an_article():
    links = "".join(f"<p><a href=x>Another story {i}</a></p>" for i in range(3))
    page = f"<article><h1>Head</h1><p>{PROSE}</p><p>So it is.</p><p>{PROSE}</p>{links}<p>More</p>{links}</article>"
    assert html_extract.main_text(page).split("\n") == ["Head", PROSE.strip(), "So it is.", PROSE.strip()]


def test_html_deep_headings_are_seen():
    page = f"<h2><span><b><i><u>Deep head</u></i></b></span></h2><div>{PROSE}</div>"
    assert [b.heading for b in html_extract.blocks(page)] == [True, False]
