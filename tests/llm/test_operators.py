"""Every operator against a plain version of its contract, on rows with nulls, repetitions, long texts and clashing names."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import (
    chat_format, license_scan, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, token_counts, topk_search,
)
from threadloom.llm.bpe import default_path, encoder
from threadloom.llm.components import components
from threadloom.llm.hamming_index import bucket_links, gray_rank

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sets(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# 7


def rules_of(t):
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(win)
    hit = {j for i, x in enumerate(win) if twice[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, rows, nothing):
    out = quality_rules.apply_policy(quality_rules.ledger(docs), "v1").collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in out]
    want = []
    for r in rows:
        m = rules_of(r[1] or "")
        want.append((r[0], *m, not (m[0] < 50 or 100 * m[4] > 50 * m[0])))
    same(got, want)
    assert quality_rules.ledger(nothing).count() == 0


def test_ablations(docs):
    book = quality_rules.ledger(docs).select("failures").collect()
    m = quality_rules.mask("v2")
    for r in quality_rules.ablations(quality_rules.ledger(docs)).collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        f = [x.failures & m for x in book]
        assert (r.failed, r.only_this, r.kept_without) == (sum(bool(x & bit) for x in f), sum(x == bit for x in f), sum(x & ~bit == 0 for x in f))


def test_quality_stage_keeps_columns(spark, docs, nothing):
    out = quality_rules.stage(spark, docs, "")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert quality_rules.stage(spark, nothing, "").count() == 0


# 5


def simhash(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, nothing):
    out = simhash_dedup.near_duplicates(docs).collect()
    prints = [simhash(r[1] or "") for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    root = sets(len(rows), pairs)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]].append(r[0])
    same([(r.doc_id, r.fingerprint, r.component_id) for r in out], [(r[0], f"{prints[i]:016x}", min(least[root[i]], default=None)) for i, r in enumerate(rows)])
    assert simhash_dedup.near_duplicates(nothing).count() == 0


def test_simhash_stage_keeps_one_of_each(spark, docs, nothing):
    kept = simhash_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns and simhash_dedup.stage(spark, nothing, "").count() == 0
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # of texts without words one stays, of the copies and near copies the first; all others stay
    assert sorted(map(repr, ids)) == sorted(map(repr, {r.doc_id for r in docs.collect()} - {1, 2, 5, 6, 7, None}))


def test_simhash_stage_with_null_and_repeated_ids(spark):
    """Null ids do not hide other null ids, and an id with two texts does not stand for both components."""
    t = [" ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:6] for i in range(60)) for k in range(6)]
    data = [(None, t[0]), (None, t[1]), (None, t[1]), (7, t[2]), (7, t[3]), (3, t[3]), (9, t[4]), (9, t[5]), (None, t[5])]
    kept = simhash_dedup.stage(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    same([tuple(r) for r in kept.collect()], [(None, t[0]), (None, t[1]), (7, t[2]), (3, t[3]), (9, t[4]), (9, t[5])])


def test_fingerprint_in_pieces(monkeypatch):
    t = " ".join(str(i * 7919 % 1000) for i in range(500))
    whole, wide = simhash_dedup.fingerprint(t), simhash_dedup.fingerprint(t, 5, 3)
    monkeypatch.setattr(simhash_dedup, "_PIECE", 37)
    assert int(simhash_dedup.fingerprint(t)[0]) == int(whole[0]) == simhash(t)
    assert simhash_dedup.fingerprint(t, 5, 3).tolist() == wide.tolist() and len(set(wide.tolist())) == 3


def near_codes(seed, centres, each, most):
    rng = np.random.default_rng(seed)
    codes = set()
    for b in rng.integers(0, 2**63, size=centres, dtype=np.uint64):
        for _ in range(each):
            x = int(b)
            for k in rng.integers(0, 64, size=rng.integers(0, most)):
                x ^= 1 << int(k)
            codes.add(x)
    return np.array(sorted(codes), dtype=np.uint64)


def every_link(codes, limit):
    return np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= limit, 1))


@pytest.mark.parametrize("size", [2, 3, 5, 40, 900])
def test_index_spans_all_links(size):
    """Buckets of every size go through the nodes, and whole groups are left out."""
    codes = near_codes(1, 12, 1 + size // 12, 6)
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    a, b, visited, pruned = bucket_links(np.zeros(len(codes), dtype=np.int64), codes[:, None], 4)
    assert sets(len(codes), every_link(codes, 4)) == sets(len(codes), zip(a, b))
    assert len(a) < len(codes) and visited > 0 and (pruned > 0 or size < 40)
    two = np.r_[codes, codes]
    a, b, *_ = bucket_links(np.repeat([3, 9], len(codes)), np.stack([two, two], axis=1), 8)
    assert sets(len(two), zip(a, b)) == sets(len(two), [*every_link(codes, 4), *(every_link(codes, 4) + len(codes))])


@pytest.mark.parametrize("crowd", [16, 1 << 20])
def test_links_of_crowded_nodes(spark, crowd, monkeypatch):
    """Splitting upper nodes loses no link, and every link comes out of the index."""
    codes = near_codes(2, 3, 300, 7)
    df = spark.createDataFrame([(int(c.view(np.int64)),) for c in codes], "code long")
    at = {int(c.view(np.int64)): i for i, c in enumerate(codes)}
    links = [(at[r.u], at[r.v]) for r in simhash_dedup.links(df, crowd=crowd).collect()]
    assert all(int(np.bitwise_count(codes[a] ^ codes[b])) <= 4 for a, b in links)
    assert sets(len(codes), every_link(codes, 4)) == sets(len(codes), links)
    r = simhash_dedup.index_counts(df, crowd=crowd).first()
    assert 0 < r.pruned < r.groups and r.links >= len(links)


@pytest.mark.parametrize("limit, codes", [(4, 10), (4, 10**8), (4, 10**11), (1, 10)])
def test_exact_masks_meet_every_link(limit, codes):
    """Any few differing bits leave the bits of some mask alone, also below another mask."""
    masks, rng = simhash_dedup.exact_masks(limit, codes), np.random.default_rng(4)
    for _ in range(2000):
        diff = sum(1 << int(k) for k in rng.choice(64, size=limit, replace=False))
        (base, *_) = [m for m in masks if not m & diff]
        assert any(not m & diff and m & base == base and m != base for m in simhash_dedup.exact_masks(limit, 0, base))


def test_stage_finds_similar_texts(spark):
    """Texts of similarity 0.8 and more by five words leave one of each group; others stay. Against all pairs."""
    import random

    rng = random.Random(11)

    def prose(n):
        return ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(n)]

    texts = []
    for k in range(40):
        w = prose(rng.randint(60, 400))
        texts.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            for _ in range(rng.choice([1, 2, 3, 6, 12])):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["", "  ", "one two three", "One two  three", "one two four", None]

    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    grams = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    root = sets(len(texts), pairs)
    kept = {r.doc_id for r in simhash_dedup.stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    want = {i for i, r in enumerate(root) if i == r}
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_stage_loses_no_link_of_a_family(spark):
    """Families whose members are similar to some and just not to others: every pair of 0.8 counts, against all pairs."""
    import random

    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8)))
    texts, family = [], []
    for k in range(40):
        w = [word() for _ in range(200)]
        for _ in range(15):
            v = list(w)
            for at in rng.sample(range(200), rng.randint(2, 7)):
                v[at] = word()
            texts.append(" ".join(v))
            family.append(k)
    grams = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if family[i] == family[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert 100 < len(pairs) < 2000
    root = sets(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.root for r in simhash_dedup.similar_groups(docs).select("least.doc_id", "root").collect()}
    assert sum(group[i] == group[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(root[i] == root[j] for i in group for j in group if group[i] == group[j])  # no other documents are joined
    kept = {r.doc_id for r in simhash_dedup.stage(spark, docs, "").collect()}
    want = {i for i, r in enumerate(root) if i == r}
    assert want <= kept and len(kept - want) <= 0.03 * (len(texts) - len(want))


@pytest.mark.parametrize("limit", [simhash_dedup.STAGE_LIMIT, -1])
def test_stage_finds_every_link(spark, limit):
    """Groups are those of all links, also of sets that no fingerprint brings together (-1: of none at all), against all pairs."""
    import random

    rng = random.Random(37)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(rng.choice([8, 40, 150, 200]))]
        for _ in range(25):
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randint(0, min(7, len(v)))):
                v[at] = word()
            texts.append(" ".join(v[rng.randint(0, 3) :]))
    # sets that are similar under far fingerprints, as a repeated line outweighs all else; and different ones under equal fingerprints
    for _ in range(5):
        base = " ".join(word() for _ in range(150))
        texts += [base + " " + f"{word()} {word()} {word()} " * 400 for _ in range(4)]
        line = f"{word()} " * 2000
        texts += [line + " ".join(word() for _ in range(20)) for _ in range(4)]
    texts += ["", None, " ", "one two", "ONE two", "one three"]

    def shingles(t):
        w = lower(t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    grams = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    root = sets(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_dedup.survivors(docs, limit=limit).collect()}
    assert kept == {i for i, r in enumerate(root) if i == r}


def test_stage_disk(spark, tmp_path):
    """What the stage holds on disk at once stays under four times its input, and little of it outlives the stage."""
    import os
    import random
    import threading

    from threadloom.llm.common import own_folder

    rng = random.Random(41)
    word = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(word) for _ in range(600)) for _ in range(2000)]
    texts += [t + " more" for t in texts[:400]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(p.stat().st_size for p in (tmp_path / "docs").glob("*.parquet"))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    places = [*local, own_folder(spark).removeprefix("file:")]

    def files():
        out = {}
        for place in places:
            for at, _, names in os.walk(place):
                for name in names:
                    try:
                        out[f"{at}/{name}"] = os.path.getsize(f"{at}/{name}")
                    except FileNotFoundError:
                        pass
        return out

    there, most, over = set(files()), [], threading.Event()
    new = lambda: sum(n for name, n in files().items() if name not in there)

    def watch():
        while not over.wait(0.05):
            most.append(new())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        kept = simhash_dedup.survivors(docs)
    finally:
        over.set()
        watcher.join()
    assert {r.doc_id for r in kept.collect()} == set(range(2000))
    for _ in range(100):  # shuffle files go in the background
        if new() < 0.5 * size:
            break
        over.clear()
        over.wait(0.1)
    assert max(most) < 4 * size and new() < 0.5 * size, (max(most) / size, new() / size)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (-5, -7), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, -5: -7, -7: -7}


# 1

SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def secrets_of(t):
    base = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in p.finditer(t) if len(m[g]) >= n)
    more = []
    for m in re.finditer(secret_scan.CANDIDATE, t):
        free = [True] * len(m[0])
        for s, _, e in base:
            for i in range(max(s, m.start()), min(e, m.end())):
                free[i - m.start()] = False
        for part in re.finditer("1+", "".join("01"[f] for f in free)):
            c, begin = m[0][part.start() : part.end()], m.start() + part.start()
            n = secret_scan.WINDOW
            if len(c) < n or not re.search(secret_scan.MIXED, c) or any(re.search(a, c) for a in secret_scan.ALLOWED) or len(re.sub(secret_scan.PLACEHOLDERS, "", c)) < n:
                continue
            k, cls = next((k, x) for k, x in enumerate(secret_scan.CLASSES) if re.search(x.regex, c))
            d = c.lower() if cls.alphabet.islower() else c
            scale = 1 << 20
            cost = [sum(round(v * math.log2(v) * scale) for v in Counter(d[i : i + n]).values()) for i in range(len(d) - n + 1)]
            hit = [i for i, x in enumerate(cost) if x <= round(n * math.log2(n) * scale - cls.bits * n * scale)]
            if hit:
                more.append((begin + hit[0], 3 + k, begin + hit[-1] + n))
    return base, sorted(base + more)


def shown(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Keys beside base spans, and with placeholder words in or around them.
KEY = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vW2xY4zA6b"
BESIDE = [
    "AKIA" + "QW3E" * 4 + "/" + KEY, KEY + "_token=abcdef", f"/sample/hooks/{KEY}", "aB3dE5fG70000I9jK1lM2nO4pQ6xY8z", "example1example2example3sample4",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", f"x {KEY}/deadbeefdeadbeefdeadbeef0/{KEY}=token=abcdefgh.{KEY}", "DEADBEEF0000123456789ABCDEF98765",
]


@pytest.fixture(scope="module")
def leaks(spark):
    texts = [
        None, "", "password:token:abcdefgh", "api_key=='x y' token==abcdef SECRET : \"s3cr3t.s3cr3t\"", "tokEn=" + "é" + " AKIA" + "A" * 15 + " AKIA" + "B" * 16,
        " ".join("deadbeefdeadbeef%08d" % i for i in range(700)), "e5" * 9000, "DEADBEEF0123456789ABCDEF98765432 x 123e4567-e89b-12d3-a456-426614174000",
        "aB3dE5fG7hI9jK1lM2nO4pQ6aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "KKey toKen=abcdef ſecret=abcdefg",
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "token=abcdefg")]


def test_secrets(spark, docs, rows, leaks, nothing):
    for df, source in ((spark.createDataFrame(leaks, "doc_id long, text string"), leaks), (docs, rows)):
        got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.report(df).collect()]
        want = []
        for r in source:
            base, every = secrets_of(r[1] or "")
            n = Counter(k for _, k, _ in base)
            want.append((r[0], n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
        same(got, want)
    assert secret_scan.report(nothing).count() == 0


def test_keys_beside_other_spans(spark):
    """What stands beside a base span or a placeholder word is found; placeholders alone are not."""
    out = secret_scan.report(spark.createDataFrame(list(enumerate(BESIDE)), "doc_id long, text string"))
    got = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s] for r in out.collect()}
    kinds = {i: [k for k, _, _ in v] for i, v in got.items()}
    assert kinds[0] == ["access", "entropy_base64"] and kinds[1] == ["entropy_base64", "assign"] and kinds[2] == kinds[3] == ["entropy_base64"]
    assert kinds[4] == kinds[5] == [] and kinds[6] == ["entropy_base64", "hex", "entropy_base64", "assign"] and kinds[7] == ["entropy_hex"]
    start, end = map(int, got[0][1][1:])
    assert BESIDE[0][start:end] == "/" + KEY


def test_secrets_in_long_runs(spark):
    """Patterns stay linear on long runs of separators, digits and letters, which no candidate test may try in all ways."""
    texts = ["-" * 60 + "1a2", "=/" * 20_000 + "1a2", "7" * 300_000, "7" * 300_000 + "!", "word_" * 40_000 + "12", "Ab-" * 40_000 + "123456789"]
    out = secret_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in out.collect()}
    assert got[2] == "hex:0:300000" and got[3] == "hex:0:300000"
    assert [got[i] for i in (0, 1, 4)] == ["", "", ""]
    assert got[5] == shown(secrets_of(texts[5])[1])


def test_many_secrets_in_one_text(spark):
    """A list of checksums, each a base span and a candidate, with other spans between."""
    digest = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(2_000)]
    text = "\n".join(f"{d} secret={d[:5]}.{d}.{d} aB3dE5fG7hI9jK1lM2nO{i}" if i % 9 == 0 else d for i, d in enumerate(digest))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    base, every = secrets_of(text)
    r = secret_scan.report(one).first()
    assert len(base) > 2_000 and len(every) > len(base)
    assert (r.n_hex, r.n_assign, r.spans) == (sum(k == 2 for _, k, _ in base), sum(k == 0 for _, k, _ in base), shown(every))


def test_redaction(spark, docs, leaks):
    out = secret_scan.redact(spark.createDataFrame(leaks, "doc_id long, text string"))
    want = []
    for i, t in leaks:
        cut = []
        for s, _, e in secrets_of(t or "")[1]:
            if cut and s <= cut[-1][1]:
                cut[-1][1] = max(e, cut[-1][1])
            else:
                cut.append([s, e])
        for s, e in reversed(cut):
            t = t[:s] + "[SECRET]" + t[e:]
        want.append((i, t))
    same([tuple(r) for r in out.collect()], want)
    assert secret_scan.stage(spark, docs, "").columns == docs.columns


# 2 and 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("head", [1 << 18, 5, 0])
def test_token_counts(docs, rows, library, nothing, head):
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, head=head).collect()]
    want = [(r[0], len((r[1] or "").encode()), n := len(ids_of(library, r[1])), n > 1024) for r in rows]
    same(got, want)
    assert token_counts.count_tokens(nothing).count() == 0


def test_encoder(library):
    e = encoder(default_path())
    texts = ["it's we'll I'M 'd ''s", "a  b\n\n c \t", "x<|endoftext|><|endoftext|> <|endoftext|", "²³½ ١٢ ئ", "Привет мир Ωμέγα", "\x1c\x1d\x85\xa0 x", "日本", "", " ", "é́԰z", "a" * 300]
    for t in texts:
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids
        pieces, special = e.pieces(t)
        assert sum(map(e.count, pieces)) + special == len(e.ids(t))


def check_packing(out, documents, capacity):
    """Gapless sequences within the capacity, whole documents, cut only if longer. Returns the number of sequences."""
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want = Counter()
    for doc_id, ids in documents:
        ids = ids + [0]
        start, end, piece = 0, len(ids) % capacity or capacity, 0
        while start < len(ids):
            want[doc_id, piece, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())] += 1
            start, end, piece = end, end + capacity, piece + 1
    assert got == want
    return len(by_seq)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, rows, library, nothing, capacity):
    documents = [(r[0], ids_of(library, r[1])) for r in rows]
    n = check_packing(packing.pack(docs, capacity=capacity).collect(), documents, capacity)
    assert n <= math.ceil(1.05 * sum(len(i) + 1 for _, i in documents) / capacity) + 1
    assert packing.pack(nothing).count() == 0


def test_plan_against_first_fit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cap = int(rng.integers(4, 60))
        hist = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, cap + 1, size=rng.integers(1, 12))}
        bins = packing.plan(dict(hist), cap)
        held = Counter()
        assert len(bins) < 3 * cap
        for b in bins:
            assert sum(s * k for s, k in b.items) + b.left == cap and b.left >= 0
            assert sum(k for s, k in b.items if s > cap // 3) <= 2
            for s, k in b.items:
                held[s] += k * b.many
        assert held == Counter(hist)
        gaps = []
        for s in sorted(Counter(hist).elements(), reverse=True):  # best fit decreasing
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else cap) - s)
        assert sum(b.many for b in bins) <= len(gaps) + 1


# 4


def test_licenses(docs, rows, nothing):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_labels(docs).collect()]
    want = []
    for r in rows:
        w = word.findall(lower(r[1] or ""))
        at = [(i, l) for p, l in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((r[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({l for _, l in at}))))
    same(got, want)
    assert license_scan.license_labels(nothing).count() == 0


def test_automaton():
    import random

    rng, s = random.Random(4), license_scan.Scanner()
    seqs = [license_scan.words(t.encode()) for _, t in license_scan.TEMPLATES]
    passages = {tuple(q[i:j]) for q in seqs for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    for _ in range(60):
        run = []
        while len(run) < 50:
            q = rng.choice(seqs)
            i = rng.randrange(len(q))
            run += q[i : i + rng.randrange(1, 9)]
        best = [next((i + 1 - k for k in range(i + 1) if tuple(run[k : i + 1]) in passages), 0) for i in range(len(run))]
        want = [(i + 1 - n, n) for i, n in enumerate(best) if n >= 4 and (i + 1 == len(run) or best[i + 1] != n + 1)]
        found = s.automaton.maximal(run, 4)
        assert [(a, n) for a, n, _ in found] == want
        for a, n, state in found:
            assert s.automaton.ends[state] == {(k, e) for k, q in enumerate(seqs) for e in range(n, len(q) + 1) if q[e - n : e] == run[a : a + n]}


def template(label):
    return next(t for k, t in license_scan.TEMPLATES if k == label)


def test_license_passages():
    s = license_scan.Scanner()
    isc = template("isc").encode()
    w = license_scan.words(isc)
    *_, labels, score, spans = s.scan(b"before " + isc + b" after " + isc)
    assert (labels, score) == ("isc", 1.0)
    assert [(x["label"], x["first_word"], x["end_word"]) for x in spans] == [("isc", 1, 1 + len(w)), ("isc", 2 + len(w), 2 + 2 * len(w))]
    broken = b" ".join(x if i % 9 else b"zz" for i, x in enumerate(w))
    labels, score, spans = s.scan(broken)[5:]
    assert labels == "isc" and 0.6 <= score < 1 and len(spans) == 1
    for p in spans[0]["passages"]:
        assert license_scan.words(broken)[p["start"] : p["start"] + p["words"]] == w[p["template_start"] : p["template_start"] + p["words"]]
    assert s.scan(b" ".join(w[::-1]))[5:7] == ("", 0.0)
    # a short quotation is no licence, and the longer of two related licences covers more
    assert s.scan(b" ".join(w[:20]))[5] == ""
    assert s.scan(template("bsd-3-clause").encode())[5].split(",")[-1] == "bsd-3-clause"


def test_license_passages_that_overlap():
    """A doubled or a lost word costs no more than itself, and a passage inside another template's counts for its own."""
    s = license_scan.Scanner()
    w = license_scan.words(template("isc").encode())
    for at in range(6, len(w) - 6, 5):
        labels, score = s.scan(b" ".join(w[: at + 1] + w[at:]))[5:7]
        assert labels == "isc" and score == 1.0
    s = license_scan.Scanner((("one", "p q a b c d e f r t"), ("two", "a b c d e f g h")))
    assert {s.labels[c.template]: c.coverage for c in s.chains(b"p q a b c d e f r t".split())} == {"one": 1.0, "two": 0.75}


def test_license_chains_against_all_chains():
    """Passages, best coverage, labels and spans of random texts, against every chain worked out by recursion."""
    import random

    rng = random.Random(15)
    templates = (("one", " ".join(rng.choice("abcd") for _ in range(14))), ("two", " ".join(rng.choice("abcde") for _ in range(11))), ("two", "a b a b a b c d e"))
    s = license_scan.Scanner(templates)
    seqs = [t.split() for _, t in templates]
    hit = 0
    for _ in range(150):
        w = []
        while len(w) < 40:
            q = rng.choice(seqs)
            i = rng.randrange(len(q))
            w += q[i : i + rng.randrange(1, 12)] + (["zz"] if rng.random() < 0.3 else [])
        text = [x.encode() for x in w]
        score, good = 0.0, []
        for k, q in enumerate(seqs):
            long = [max((n for n in range(1, i + 2) if any(q[j : j + n] == w[i + 1 - n : i + 1] for j in range(len(q)))), default=0) for i in range(len(w))]
            hits = sorted(
                (i + 1 - n, j, n) for i, n in enumerate(long) if n >= license_scan.SEED and (i + 1 == len(w) or long[i + 1] != n + 1)
                for j in range(len(q)) if q[j : j + n] == w[i + 1 - n : i + 1]
            )
            assert s.passages(text).get(k, []) == hits

            def best(i):
                """Most words of a chain that ends with hits[i]."""
                at, tpl, n = hits[i]
                out = n
                for j in range(i):
                    a, t, m = hits[j]
                    gap, tgap = at - a - m, tpl - t - m
                    over = max(0, -gap, -tgap)
                    near = at <= a + len(q) + license_scan.GAP and over < n and a <= at and t <= tpl and max(gap, tgap) + over <= license_scan.GAP
                    if near:
                        out = max(out, best(j) + n - over)
                return out

            covers = [best(i) / len(q) for i in range(len(hits))]
            score = max([score, *covers])
            if any(c >= license_scan.COVER for c in covers):
                good.append((templates[k][0], max(covers)))
        *_, labels, got, spans = s.scan(b" ".join(text))
        assert got == pytest.approx(score) and labels == ",".join(sorted({x for x, _ in good}))
        for x in spans:
            parts = x["passages"]
            total = parts[0]["words"] + sum(license_scan.added(tuple(a.values()), tuple(b.values())) for a, b in zip(parts, parts[1:]))
            assert any(total / len(q) == pytest.approx(x["coverage"]) for q in seqs) and (x["first_word"], x["end_word"]) == (parts[0]["start"], parts[-1]["start"] + parts[-1]["words"])
        for x, c in good:
            assert max(y["coverage"] for y in spans if y["label"] == x) >= c - 1e-9
        hit += len(spans)
    assert hit > 50


# 6


def test_chat(spark):
    turns = [
        (1, 1, "assistant", "b\\x <|turn|> \\e", 9), (1, 0, "user", "a <|tur<|turn|>n|></s>", 9), (2, 0, "assistant", None, 9), (2, None, None, "[[INST]]", 9), (2, 0, "assistant", "", 9),
        (None, 3, "user\n", "x\n<|end|>\n", 9), (4, 0, "system", "s", 9), (4, 1, "user", "q", 9), (4, 2, "assistant", "y" * 70_000, 9), (4, 3, "assistant", "z", 9), (4, 3, "assistant", "z", 9),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns int")
    groups = defaultdict(list)
    for c, t, r, x, _ in turns:
        groups[c].append(((t is not None, t or 0, r or "", x or "")))
    made = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert made.keys() == groups.keys()
    for c, g in groups.items():
        g = [(r, x) for _, _, r, x in sorted(g)]
        assert [(t.role, t.text) for t in made[c].turns] == g
        assert made[c].loss_text == "".join(x for r, x in g if r == "assistant")
        assert made[c].formatted.count("<|turn|>") == len(g) == made[c].formatted.count("<|end|>")
    assert [made[k].valid for k in (1, 2, None, 4)] == [True, False, False, False] and made[4].bad_turn == 3


def test_chat_query(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = chat_format.op6_chat_format(spark, str(tmp_path)).collect()
    t = chat_format.PROBE_TEXT
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(t)) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# 9


@pytest.mark.parametrize("shard, visitors, cell", [(16384, 16384, 1024), (50, 3, 20), (7, 1, 4)])
def test_topk(spark, shard, visitors, cell, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL", cell)
    rng = np.random.default_rng(6)
    v = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    v += [(400 + i, v[3][1]) for i in range(150)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (None, v[0][1]), (503, [1.0]), (550, [2.0]), (600, [])]
    v += [(1000 + i, [float(i)] * 300) for i in range(4)] + [(1050, [0.0] * 8), (1051, [-0.0] * 8)]
    df = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in v], "vec_id long, embedding array<float>, rank int, q int, cell int")
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0"), shard=shard, visitors=visitors).collect()
    ok = [(i, [math.floor(256 * c) for c in x]) for i, x in v if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i and len(x) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], want)
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk_search.top_k(df.where("false"), df).count() == 0 and topk_search.top_k(df, df.where("false")).count() == 0


def test_topk_repeated_rows(spark):
    """A repeated query counts once per different vector, repeated candidates each, and never a query's own id."""
    v = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(df, df.where("vec_id = 50")).collect()]
    s = 65536
    same(got, [(50, 1, 1, 3 * s), (50, 2, 1, 3 * s), (50, 3, 2, 0), (50, 1, 2, 2 * s), (50, 2, 1, 0), (50, 3, 1, 0)])


def test_topk_leaves_cells_out(spark):
    """On clustered vectors most visits are dropped before vectors move."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 4
    v = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.1]) for i in range(4000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    counts = topk_search.search_counts(df, df.where("vec_id % 50 = 0"))
    assert sum(n for n, _ in counts) < 0.6 * counts[0][1]


# 10


def test_mixing(spark, nothing):
    rng = np.random.default_rng(7)
    t = mixing.Targets({"a": 0.2, "b": 0.3, "*": 0.5}, {"en": 0.6, "*": 0.4}, {"license": 0.1, "contact": 0.1, "numbers": 0.1, "*": 0.7})
    words = ["plain", "license", "me@x", "12345"]
    data = [(i, " ".join(["w"] * int(rng.integers(1, 20)) + [words[int(rng.integers(0, 4))]]), "en" if rng.random() < 0.8 else None, "abc"[int(rng.integers(0, 3))]) for i in range(600)]
    data += [(None, None, None, None), (5, "", "en", "a"), data[7]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, t).collect()
    assert len(out) == len(data)
    cells = Counter()
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    w = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d, (_, shares) in enumerate(t.dims()):
            sums = Counter()
            for k, v in w.items():
                sums[k[d]] += v
            met = sum(g for c, g in shares.items() if sums[c] > 0)
            w = {k: v * shares[k[d]] / met / sums[k[d]] for k, v in w.items()}
    total = sum(cells.values())
    most = max(w[k] / (cells[k] / total) for k in w if cells[k])
    kept = Counter()
    for r in out:
        k = (r.source, r.lang, r.topic)
        assert r.probability == pytest.approx(w[k] / (cells[k] / total) / most if cells[k] else 1.0)
        kept["source", r.source] += r.n_tokens * r.probability
        kept["lang", r.lang] += r.n_tokens * r.probability
    mass = sum(v for (d, _), v in kept.items() if d == "lang")
    for c, g in t.source.items():
        assert kept["source", c] / mass == pytest.approx(g, abs=1e-3)
    same([(r.doc_id, r.sampled) for r in mixing.mix(df.repartition(7), t).collect()], [(r.doc_id, r.sampled) for r in out])
    assert {r.residual for r in out} == {0.0}
    mass = sum(kept[d, c] for d, c in kept if d == "source")
    for r in mixing.marginals(mixing.mix(df, t), t).collect():
        if r.dimension != "topic":
            assert r.target == t.dims()[("source", "lang").index(r.dimension)][1][r.category]
            assert r.expected == pytest.approx(kept[r.dimension, r.category] / mass) and r.expected == pytest.approx(r.target, abs=1e-3)
    # a topic column instead of the patterns, and columns that are called like those of the result
    more = df.withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "license")).withColumn("probability", F.lit(7)).withColumn("row", F.lit("x")).withColumn("factor", F.lit(None))
    named = mixing.mix(more, t, topic=F.col("topic")).collect()
    assert all(r.topic == ("license" if r.doc_id is not None and r.doc_id % 3 == 0 else "*") for r in named)
    assert mixing.stage(spark, more, "").columns == more.columns and mixing.stage(spark, more, "").count() > 100
    assert mixing.mix(nothing).count() == 0 and mixing.stage(spark, nothing, "").columns == nothing.columns


def test_mixing_targets_that_cannot_be_met(spark):
    """What is out of reach shows in the residual; shares that do not add up are refused."""
    t = mixing.Targets({"a": 0.9, "*": 0.1}, {"en": 0.5, "*": 0.5}, {"*": 1.0})
    df = spark.createDataFrame([(i, "w " * 10, "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string")
    assert {r.residual for r in mixing.mix(df, t).collect()} == {0.5}
    for bad in ({"a": 0.9, "*": 0.2}, {"a": 1.0}, {"a": 1.1, "*": -0.1}):
        with pytest.raises(ValueError):
            mixing.Targets(bad, {"*": 1.0}, {"*": 1.0})


def test_mixing_with_one_odd_row(spark):
    """A category of one short document changes neither the rate of the others nor their balance."""
    rng = np.random.default_rng(8)
    t = mixing.Targets({"a": 0.4, "b": 0.55, "*": 0.05}, {"en": 0.7, "fr": 0.28, "*": 0.02}, {"license": 0.1, "*": 0.9})
    data = [(i, "w " * 50 + ("license" if rng.random() < 0.1 else "w"), "en" if rng.random() < 0.8 else "fr", "ab"[int(rng.random() < 0.5)]) for i in range(2000)]
    kind = "doc_id long, text string, lang string, source string"

    def rates(more):
        out = mixing.mix(spark.createDataFrame(data + more, kind), t).collect()
        return {r.doc_id: r.probability for r in out}, sum(r.sampled for r in out)

    plain, kept = rates([])
    assert kept > 800
    for odd in ((-1, "w " * 30, None, "a"), (-1, "w " * 30, "en", "new"), (-1, "w license", None, None)):
        p, n = rates([odd])
        assert p[-1] == 1.0 and abs(n - kept) < 20
        assert max(abs(p[i] - x) for i, x in plain.items()) < 0.02


# 3


def test_classifier(spark, docs, nothing):
    good = [(i, "".join(chr(97 + (i * 7 + j * j) % 26) if j % 6 else " " for j in range(400)), "en", f"s{i % 3}") for i in range(120)]
    bad = [(1000 + i, "BUY NOW!! ### $$$ " * (10 + i), "en", "s9" if i % 2 else "s1") for i in range(60)]
    df = spark.createDataFrame(good + bad + [(None, None, None, None)], "doc_id long, text string, lang string, source string")
    said = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(1000 + i, 0) for i in range(0, 60, 2)] + [(None, 1), (2, 1), (4, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(df, said).collect()}
    held = [i for i in range(1, 120, 2)] + [1000 + i for i in range(1, 60, 2)]
    assert sum(out[i].kept == (i < 1000) for i in held) / len(held) > 0.97
    assert out[1001].path_posterior < out[1].path_posterior
    none = quality_classifier.classify(docs, said.where("false"))
    assert none.count() == docs.count() and none.where("not kept").count() == 0
    assert quality_classifier.classify(nothing, said).count() == 0


def plain_classifier(rows, said):
    """(evidence, host posterior, path posterior, score) per row, worked out in plain Python."""
    from statistics import fmean

    q = quality_classifier
    x = [q.features((t or "").encode()) for _, t, _, _ in rows]
    seen, told = defaultdict(list), defaultdict(list)
    for i, y in said:
        if i is not None and y is not None:
            told[i].append(y)
    for r, v in zip(rows, x):
        if r[0] in told:
            seen[r[0]].append(v)
    fx, fy = [[fmean(c) for c in zip(*v)] for v in seen.values()], [fmean(told[i]) for i in seen]
    w, b = q.fit(np.array(fx), np.array(fy))
    rate = min(0.99, max(0.01, fmean(fy)))
    odds = [min(12.0, max(-12.0, b + sum(c * d for c, d in zip(v, w)))) for v in x]
    p = [fmean(told[r[0]]) if r[0] in told else 1 / (1 + math.exp(-o)) for r, o in zip(rows, odds)]
    host, path = [r[3] or "" for r in rows], [f"{r[3] or ''}/{r[2] or ''}" for r in rows]
    mean = min(0.99, max(0.01, fmean(p)))

    def sites(names):
        good, n = Counter(), Counter()
        for s, v in zip(names, p):
            good[s] += v
            n[s] += 1
        noise = mean * (1 - mean)
        spread = sum(n[s] * (good[s] / n[s] - mean) ** 2 for s in n)
        between = max(0.0, (spread - noise * len(n)) / sum(n.values()))
        k = q.STRENGTH[1] if len(n) < 2 or not between else min(q.STRENGTH[1], max(q.STRENGTH[0], noise / between - 1))
        return good, n, k

    (hg, hn, hk), (pg, pn, _) = sites(host), sites(path)
    # paths spread around their own host: sums over hosts, each with its own rate and its paths less one degree of freedom
    spread = noise = free = each = 0.0
    for h in hn:
        own, m = {s for s, g in zip(path, host) if g == h}, hg[h] / hn[h]
        spread += sum(pn[s] * (pg[s] / pn[s] - m) ** 2 for s in own)
        noise += m * (1 - m) * (len(own) - 1)
        free += hn[h] - sum(pn[s] ** 2 for s in own) / hn[h]
        each += hn[h] * m * (1 - m) / len(p)
    between = max(0.0, (spread - noise) / free) if free else 0.0
    pk = min(q.STRENGTH[1], max(q.STRENGTH[0], each / between - 1)) if between else q.STRENGTH[1]
    out = []
    for r, o, v, h, s in zip(rows, odds, p, host, path):
        hp = (hk * mean + hg[h] - v) / (hk + hn[h] - 1)
        pp = (pk * hp + pg[s] - v) / (pk + pn[s] - 1)
        inside = min(1 - 1e-4, max(1e-4, pp))
        e = o - math.log(rate / (1 - rate))
        out.append((e, hp, pp, 1 / (1 + math.exp(-(e + math.log(inside / (1 - inside)))))))
    return out


@pytest.mark.parametrize("hot", [1, 1 << 14])
def test_classifier_against_plain_version(spark, hot, monkeypatch):
    """Both posteriors, the prior strengths and the score, with hot sites broadcast and without."""
    from threadloom.llm import common

    monkeypatch.setattr(common, "_LEAST_HOT", hot)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(500):
        site = f"h{min(int(rng.exponential(3)), 12)}"
        good = rng.random() < (0.9 if site in ("h0", "h3", "h5") else 0.2)
        text = " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(int(rng.integers(3, 60)))) + (" plain" if good else " BUY!! #1")
        rows.append((i, text, rng.choice(["en", "fr"]), site))
    rows += [(None, None, None, None), (None, "x", "en", None), rows[5], rows[5], (3, "another text of the same id", "fr", "h0")]
    said = [(i, int(rng.random() < 0.5)) for i in range(0, 300, 3)] + [(6, 1), (6, None), (None, 1), (9999, 1)]
    df = spark.createDataFrame([(None if a is None else int(a), b, None if c is None else str(c), d, 1.0, "h") for a, b, c, d in rows], "doc_id long, text string, lang string, source string, p double, host string")
    got = quality_classifier.classify(df, spark.createDataFrame(said, "doc_id long, quality int"))
    key = lambda t: (str(t[0]), *[round(float(v), 6) for v in t[1:]])
    mine = sorted(key((r.doc_id, r.evidence, r.host_posterior, r.path_posterior, r.score)) for r in got.collect())
    assert mine == sorted(key((r[0], *v)) for r, v in zip(rows, plain_classifier(rows, said)))


def test_paths_shrink_to_their_host(spark):
    """Hosts that differ and paths that are like their host: the spread between hosts says nothing about paths."""
    rows = [(f"h{h}/{p}", 50.0 * (0.9 if h % 2 else 0.1), 50.0, 200.0 * (0.9 if h % 2 else 0.1), 200.0) for h in range(20) for p in range(4)]
    alike = spark.createDataFrame(rows, "path string, path_good double, path_n double, host_good double, host_n double")
    assert quality_classifier._strength_within(alike) == quality_classifier.STRENGTH[1]
    torn = alike.withColumn("path_good", F.when(F.col("path").endswith("/0") | F.col("path").endswith("/1"), F.col("path_n") * 0.95).otherwise(F.col("path_n") * 0.05)).withColumn("host_good", F.col("host_n") * 0.5)
    assert quality_classifier._strength_within(torn) == quality_classifier.STRENGTH[0]  # the rates differ more than the least strength says
    assert quality_classifier._strength_within(alike.limit(0)) == quality_classifier.STRENGTH[1]


def test_fit_is_the_optimum():
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(300, 9)), (rng.random(300) < 0.4).astype(float)
    w, b = quality_classifier.fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(z.T @ (y - p) - quality_classifier.RIDGE * w * (x.std(0) + 1e-9)).max() < 1e-4


def test_sites_help_where_texts_say_little(spark):
    """Sites of one quality each, texts that tell nothing: labels of a site's other documents order the unlabelled ones."""
    rng = np.random.default_rng(14)
    rows, good = [], {}
    for i in range(600):
        site = i % 30
        good[i] = site % 2 == 0
        rows.append((i, " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(int(rng.integers(5, 60)))), "en", f"s{site}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    said = spark.createDataFrame([(i, int(good[i])) for i in range(0, 600, 7)], "doc_id long, quality int")
    out = [r for r in quality_classifier.classify(df, said).collect() if r.doc_id % 7]

    def auc(value):
        up, down = [value(r) for r in out if good[r.doc_id]], [value(r) for r in out if not good[r.doc_id]]
        return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))

    assert auc(lambda r: r.score) > 0.75 > 0.6 > auc(lambda r: r.evidence)


def test_labelled_sample_is_bounded(spark):
    """Whole levels of hashes, never more than the bound, repeated ids one row each."""
    x = [0.5] * len(quality_classifier.FEATURES)
    known = spark.createDataFrame([(i % 5000, x) for i in range(6000)], "doc_id long, x array<double>").repartition(16)
    said = spark.createDataFrame([(i, 1.0) for i in range(0, 10_000, 2)], "doc_id long, y double")
    taken = {n: quality_classifier.labelled(known, said, n).count() for n in (0, 1, 100, 1000, 10_000)}
    assert taken[10_000] == 2500 and taken[0] == 0 and taken[1] <= 1 and 60 <= taken[100] <= 100 and 850 <= taken[1000] <= 1000


def test_shrinkage(spark):
    """A site of one document stays nearer to the whole than a site of many."""
    rows = [(i, "BUY!! ### $$$ " * 20, "en", "big") for i in range(50)] + [(100, "BUY!! ### $$$ " * 20, "en", "small")] + [(200 + i, "plain words follow here " + "abc def " * i, "en", "good") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    said = spark.createDataFrame([(r[0], int(r[0] >= 200)) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(df, said).collect()}
    assert out[0].path_posterior < out[100].path_posterior < out[200].path_posterior


# pipeline


def test_pipeline(spark, docs, tmp_path, library):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    cur, last = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "secret_scan", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        last, cur = cur, spark.read.parquet(f"{tmp_path}/{name}")
        if name != names[-1]:
            assert cur.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    check_packing(cur.collect(), [(r.doc_id, ids_of(library, r.text)) for r in last.collect()], 2048)
    same(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect(), cur.select("doc_id", "piece", "ids_crc32").collect())


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_tables(spark, docs, nothing, empty):
    """Every stage on an empty table, and on one of nulls, blanks and repeated rows, alone."""
    import corpus_pipeline

    blank = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, None, None, "a"), (None, " \n", "x", None)], "doc_id long, text string, lang string, source string")
    cur = nothing if empty else blank
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, cur, "")
        assert out.columns == cur.columns
        n = {"quality_rules": 0, "simhash_dedup": 1, "secret_scan": 5, "mixing": 5}[name]
        assert out.count() == (0 if empty else n)
    last = corpus_pipeline.STAGES[-1][1](spark, cur, "").collect()
    assert sorted(r.length for r in last) == ([] if empty else [1, 1, 1, 1, 3])


def test_pipeline_on_an_empty_table(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    """Without the setting a local session makes its own folder; any other master is refused."""
    from threadloom.llm import common

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_oracles(spark):
    """Queries with SQL give the SQL's rows on the smallest driver tables, if those are there."""
    import os

    import duckdb

    from threadloom.llm import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        same([tuple(r) for r in df.select(cols).collect()], want)
        assert json.dumps(cols)
