"""Operators against brute force on a fixture of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kinweave.llm import byte_bpe, chat_format, language_zstd, packing, pretokens, quality_mcd, queries, secret_scan, simhash_trie, spot_signatures, token_counts, toxicity_fm

WORDS = "The the of and to in is der die und le la et que el los reation ention achkeit mentaux ción 12 x7 don't 'll we've É ß 中文 😀".split()
SF = "/root/testdata/sf0.001"


def make_rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "x" * 3000, "ab1" * 900, "<|endoftext|> x <|endoftext|>", "İ Σς é " * 30, "\n\nq\n\nq\n", "\x1c\x85\xa0 a　b"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 400))) + rng.choice(["", "\n", ".\n" + "same line\n" * 3]) for _ in range(60)]
    texts += [texts[20], texts[20] + " more", texts[21].upper(), " ".join(rng.choices(WORDS, k=30_000))]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None])) for i, t in enumerate(texts)]
    return [*rows, (3, "a", "en", "s0"), (3, "a", "en", "s0"), (None, "no id at all", "en", "s0")]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(*r, "extra", 1, 2.5, "z") for r in rows]
    return spark.createDataFrame(clash, SCHEMA + ", n_tokens string, fp int, score double, TEXT string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, rows, expected):
    """The result's rows are those of the input, as a bag."""
    return Counter(map(tuple, df.collect())) == Counter(expected)


def test_token_counts(docs, nothing, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    for chunk, overlap in ((32_768, 256), (150, 4)):
        got = token_counts.token_counts(queries.texts(docs), chunk=chunk, overlap=overlap, keep=["doc_id"]).drop("n_chunks")
        assert by_text(got, rows, [(i, len((t or "").encode()), count(t), count(t) > 2048) for i, t, *_ in rows])
    assert token_counts.token_counts(nothing).count() == 0


def test_token_counts_latin():
    counter = token_counts.ChunkCounter()
    for c in map(chr, range(1, 256)):
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}1"):
            assert counter.count(text)[0] == counter.count_all([text])[0][0] == len(counter.whole.encode(text, add_special_tokens=False))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(docs, nothing, rows):
    got = quality_mcd.quality_rules(docs, min_group=10)
    expected = []
    for i, t, *_ in rows:
        b = base(t)
        expected.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert by_text(got.drop("kept", "distance"), rows, expected)
    assert not got.where("kept and base_failed").count()
    assert quality_mcd.quality_rules(nothing).count() == 0


def test_quality_of_labelled_rows(spark):
    kept = quality_mcd.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = kept.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    shares = dict(map(tuple, good))
    assert shares[1] > 0.97 and shares[0] < 0.2


def test_quality_does_not_depend_on_partitions(spark, docs):
    a = quality_mcd.quality_rules(docs.coalesce(1), min_group=10)
    b = quality_mcd.quality_rules(docs.repartition(7), min_group=10)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def check_packing(pieces, rows, window=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in rows)
    assert sum(len(k) * n for k, n in ids.items()) == sum(p["length"] for p in pieces)
    sequences = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
    total = padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.01 * total
    return ids


def test_packing(docs, nothing, rows):
    named = [r for r in rows if r[0] is not None and r[0] != 3]
    pieces = packing.pack(docs.where("doc_id is not null and doc_id <> 3")).collect()
    check_packing(pieces, named)
    whole = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["start"] * 4 == len(whole.setdefault(p["doc_id"], b""))
        whole[p["doc_id"]] += bytes(p["ids"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t, *_ in named:
        assert np.frombuffer(whole[i], "<u4").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    check_packing(packing.pack(docs).collect(), rows)
    assert packing.pack(nothing).count() == 0


def test_sum_of_squares_level():
    rng = random.Random(2)
    packer = packing.SumOfSquares(30)
    for _ in range(400):
        size = rng.randint(1, 29)
        counts = packer.counts.copy()

        def after(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 30:
                c[level + size] += 1
            return int((c[1:30] ** 2).sum())

        options = [h for h in range(1, 31 - size) if counts[h]] + [0]
        chosen = packer.level_for(size)
        assert after(chosen) == min(map(after, options))
        packer.place(("d", 0, size), size)


def test_pretokens_and_byte_bpe(docs, nothing, rows):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "s", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "1", "!", "é", "中", "　", "'ve", "\x1c", "\x85", "²", "😀", "l"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t, *_ in rows]
    assert [[p.decode() for p in own] for own in pretokens.pretokens(texts)] == [pattern.findall(t) for t in texts]
    codec = byte_bpe.Codec(cache=500)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert byte_bpe.unpack(ids) == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        assert codec.offsets(ids)[-1] == len(t.encode())
    got = byte_bpe.round_trip(queries.texts(docs), keep=["doc_id"])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda t: library.encode_ordinary(t or "")
    assert by_text(got, rows, [(i, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows])
    assert byte_bpe.round_trip(nothing).count() == 0
    assert byte_bpe.encode_documents(docs.select("doc_id", docs.columns[1] and F.lit("ab c").alias("text"))).first()["byte_offsets"][-1] == 4


def test_scan_has_the_states_of_a_walk():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("a1!' \nsdrevl", k=rng.randint(1, 600)))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.array([0])
        assert pretokens.boundaries(codes, starts).tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_chat_format(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a <|im_end|>\\ </s>"), (1, 3, "assistant", None), (1, 4, "user\nx", "q"), (1, 4, "user\nx", "q"), (2, 0, None, ""), (None, None, "assistant", "lone [INST]\n"), (3, 0, "system", "<<SYS>>"), (3, 1, "assistant", "\\[INST]<s>"), (3, 2, "assistant", "中😀<|im_sep|>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(([r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""] for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(r, t) for _, r, t in own]
        assert list(out[conv]["loss_texts"]) == [t for _, r, t in own if r == "assistant"]
        assert out[conv]["n_turns"] == len(own)
    assert out[1]["n_blocks"] == 3 and out[3]["n_blocks"] == 2
    body = out[3]["formatted"]
    assert body.count("<s>") == 1 and body.count("</s>") == 1 and "[INST]" not in body and body.count("<|im_sep|>") == 1
    assert chat_format.format_conversations(df.where("false")).count() == 0


def compare_with_sql(spark, name, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = con.sql(queries.ORACLE_SQL[name])
    mine = queries.QUERIES[name](spark, sf)
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    assert Counter(map(tuple, mine.select(*columns).collect())) == Counter(sql.select(*columns).fetchall())


def test_chat_format_against_sql(spark):
    compare_with_sql(spark, "op7_chat_format")


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    fps = [f for _, f in pairs]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        r = find(k)
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return [least[find(k)] for k in range(len(pairs))]


def test_simhash(docs, nothing, rows):
    pairs = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    expected = [(i, f - (1 << 64) if f >> 63 else f, c) for (i, f), c in zip(pairs, brute_components(pairs), strict=True)]
    assert by_text(simhash_trie.near_duplicates(docs), rows, expected)
    assert simhash_trie.near_duplicates(nothing).count() == 0


def near_values(rng, groups, each):
    out = []
    for _ in range(groups):
        center = rng.getrandbits(64)
        for _ in range(each):
            x = center
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("cap", [8192, 16])
def test_trie_links(spark, cap):
    values = near_values(random.Random(cap), 12, 25)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = simhash_trie.links(df, group_cap=cap, batch=64).collect()
    at = {v: k for k, v in enumerate(values)}
    un = lambda x: at[x & ((1 << 64) - 1)]
    u, v = (np.array([un(r[k]) for r in got]) for k in range(2))
    brute = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    a, b = (np.array(x) for x in zip(*brute, strict=True))
    n = len(values)
    assert np.array_equal(simhash_trie.local_roots(n, u, v), simhash_trie.local_roots(n, a, b))


def test_trie_in_small_pieces():
    values = np.array(near_values(random.Random(9), 5, 200), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    u, v = simhash_trie.trie_links(values, np.array([0]), frontier=50)
    assert np.array_equal(simhash_trie.local_roots(len(values), u, v), simhash_trie.local_roots(len(values), *np.nonzero(near)))


SECRETS = [
    'password = "hunter2secret"', "PASSWD:abc", "api_key='A1b2C3d4E5'", "apikey=  xxxxxx", "ſecret: nothing99", "AKIA" + "A" * 15, "AKIA" + "Z9" * 10 + "x", "f" * 24 + "g" + "0" * 23,
    "token: 0123456789abcdef0123456789abcdef", "login: bob\nkey wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY at https://api.example.com:8443/v1", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY alone",
    "login: bob\n\n" + "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "ASIAABCDEFGH12345678 with secret=abcdef123", "é中 token=zzzzzz, 😀secret:yyyyyy",
]


def brute_base(text):
    found = []
    low = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(low + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secret_scan.STRONG[k]) for a, k, b in sorted(found)]


def brute_links(text, base, reach):
    """Every pair of parts looked at."""
    apart = lambda x, y: y[0] - x[1] if x[1] <= y[0] else x[0] - y[1] if y[1] <= x[0] else -1
    near = lambda x, y: 0 <= apart(x, y) <= reach and not re.search(r"\n[\x20\t\r]*\n", text[min(x[1], y[1]) : max(x[0], y[0])])
    free = lambda pattern: [x for x in secret_scan._weak(pattern, text) if all(apart(x, b[:2]) >= 0 for b in base)]
    weak_ids, weak_secrets, ends = free(secret_scan._WEAK_ID), free(secret_scan._WEAK_SECRET), free(secret_scan._ENDPOINT)
    ids = weak_ids + [b[:2] for b in base if b[2] == "access"]
    secrets = weak_secrets + [b[:2] for b in base if b[2] != "access"]
    some = lambda x, others: any(near(x, o) for o in others)
    out = list(base) + [(*x, "access_part") for x in weak_ids if some(x, secrets)] + [(*x, "secret_part") for x in weak_secrets if some(x, ids)]
    out += [(*x, "endpoint_part") for x in ends if some(x, ids) and some(x, secrets)]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_secret_scan(spark, docs, nothing, rows):
    for text in [*SECRETS, "\n".join(SECRETS), *(t for _, t, *_ in rows if t)]:
        assert secret_scan.scan(text)[0] == brute_base(text)
    kinds = [Counter(k for _, _, k in secret_scan.scan(t)[1]) for t in SECRETS]
    assert kinds[9] == {"access_part": 1, "secret_part": 1, "endpoint_part": 1}
    assert not kinds[10] and not kinds[11]
    assert kinds[12] == {"assign": 1, "access_part": 1}
    assert secret_scan.scan("akiabcdefghijkl secret=abcdefgh")[1] == [(16, 31, "assign")]
    rng = random.Random(11)
    words = ["login: bob", "token=abcdefg", "wJalrXUtnFEMIK7MDENGbPxRf", "AKIA" + "Q" * 17, "word", "\n\n", "https://a.example/x", "f" * 30]
    for _ in range(300):
        t = " ".join(rng.choices(words, k=rng.randint(1, 25)))
        base, every = secret_scan.scan(t, 30)
        assert set(base) <= set(every) and every == brute_links(t, base, 30)
    text = SECRETS[9]
    assert "wJalr" not in secret_scan.redact(text, secret_scan.scan(text)[1])
    assert secret_scan.scan_secrets(docs.select(*docs.columns[:1], docs.columns[2], F.lit("token=abcdefg").alias("text"))).where("size(base_spans) = 1").count() == len(rows)
    assert secret_scan.scan_secrets(nothing).count() == 0


@pytest.mark.parametrize("length", [20, 200, 201, 5000])
def test_secret_of_any_length(length):
    secret = ("xY3" * length)[:length]
    text = f"client_id: bob at https://api.example.com/v1\nkey {secret}=="
    base, every = secret_scan.scan(text)
    assert not base and [k for _, _, k in every] == ["access_part", "endpoint_part", "secret_part"]
    assert secret_scan.redact(text, every) == "client_id: [access_part] at [endpoint_part]\nkey [secret_part]"
    for other in (secret.lower(), secret.upper(), "xYz" * length, "xY3" * 6, secret + "==="):
        assert not secret_scan.scan(text.replace(secret + "==", other))[1]


def test_secret_parts_link_across_a_scope():
    """However far apart, but not over a blank line."""
    parts = ["login: bob", "key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "https://a.example/x"]
    for gap in (" word" * 100, "\n# a comment" * 3000):
        kinds = [k for _, _, k in secret_scan.scan(gap.join(parts))[1]]
        assert kinds == ["access_part", "secret_part", "endpoint_part"]
        assert not secret_scan.scan((gap + "\n \n" + gap).join(parts))[1]
    rng = random.Random(12)
    words = [*parts, "token=abcdefg", "AKIA" + "Q" * 17, "word " * 200, "\n\n"]
    for _ in range(100):
        t = " ".join(rng.choices(words, k=rng.randint(1, 20)))
        assert secret_scan.scan(t)[1] == brute_links(t, secret_scan.scan(t)[0], len(t))


def brute_spots(text):
    flat = (text or "").lower().translate({ord(c): " " for c in spot_signatures._SPACES} | {ord(c): None for c in spot_signatures._SIGNS})
    words = [w for w in flat.split(" ") if w]
    anchors = set(spot_signatures.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in anchors][:2] if w in anchors else []
        if chain:
            found.add((w, *chain))
    return found or ({text} if text else set())


def test_spot_signatures(spark, docs, nothing, rows):
    named = [(i, t) for i, t, *_ in rows if i is not None and len(t or "") < 5000]
    df = spark.createDataFrame(named, "doc_id long, text string")
    got = spot_signatures.edited_and_next(df.repartition(5)).withColumn("a", spot_signatures.likeness(F.col("signatures"), F.col("edited_signatures"))).withColumn("b", spot_signatures.likeness(F.col("signatures"), F.col("next_signatures"))).collect()
    h = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(((i, t or "") for i, t in named), key=lambda r: (-r[0], h[r[1]]))
    expected = []
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        own = brute_spots(t)
        expected.append((i, edited, len(own), round(jaccard(own, brute_spots(edited)), 9), round(jaccard(own, brute_spots(following)), 9)))
    assert Counter((r["doc_id"], r["edited"], len(r["signatures"]), round(r["a"], 9), round(r["b"], 9)) for r in got) == Counter(expected)
    assert spot_signatures.edited_and_next(docs).count() == len(rows)
    assert spot_signatures.edited_and_next(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_count_above(spark, n):
    falling = [float(3 * k) for k in reversed(range(n))]
    got = spark.range(-2, 620, 7).select("id", spot_signatures._count_above(falling, F.col("id").cast("double")).alias("c")).collect()
    assert all(r["c"] == sum(b > r["id"] for b in falling) for r in got)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_language(spark, docs, nothing, rows):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_zstd.identify(queries.texts(docs, "lang"), keep=["doc_id"]).collect()}
    assert {i for i, p in got if p == "und"} >= {0, 1, 2}
    assert {p for _, p in got} <= {"en", "de", "und"}
    assert language_zstd.identify(nothing).count() == 0
    sf = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op5_language_zstd(spark, sf).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    right, rejected, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97 and rejected < 0.03


def test_toxicity(spark, docs, nothing, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = toxicity_fm.toxicity(docs, labels, keep=["doc_id"])
    assert got.count() == len(rows) and not got.where("score is null or score < 0 or score > 1 or isnan(score)").count()
    assert toxicity_fm.toxicity(docs, labels.where("false"), keep=["doc_id"]).where("score > 0.01").count() == 0
    assert toxicity_fm.toxicity(nothing, labels).count() == 0
    sf = "/root/testdata/sf0.1"
    out = queries.op4_toxicity_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    caught = out.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    false = out.where("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert caught >= 0.9 and false <= 0.005


def test_toxicity_of_rare_terms(spark, monkeypatch):
    """An insult that the sample hardly holds, and a table of few toxic rows."""
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choices(WORDS, k=12))
    rows = [(i, plain() + (" zorgle" if i % 10 == 0 else " qwibble" if i % 97 == 1 else ""), int(i % 10 == 0 or i % 97 == 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    word = lambda model, text: model.score([model.buckets.index(b) for b in toxicity_fm.Terms(toxicity_fm.BITS).of(text) if b in model.buckets])
    for most in (100, 4000):
        model = toxicity_fm.train(df, max_rows=most)
        assert word(model, "zorgle") > 0.7 and word(model, "qwibble") > 0.7 and word(model, "nothing") < 0.3
    assert word(toxicity_fm.train(df.where("doc_id < 31")), "zorgle") > word(toxicity_fm.train(df.where("doc_id < 31")), "nothing") + 0.3
    labels = df.select("doc_id", "toxic")
    one = sorted(toxicity_fm.labelled_terms(df, labels).collect())
    monkeypatch.setattr(toxicity_fm, "BROADCAST_LABELS", 0)
    assert sorted(toxicity_fm.labelled_terms(df, labels).collect()) == one and len(one) > 2000


def test_machine_learns_a_pair():
    """Neither term alone tells the label, both together do."""
    rng = random.Random(4)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted([0] * a + [1] * b + [2 + rng.randrange(5)]))
        labels.append(float(a and b))
    bias, w, v = toxicity_fm.fit(toxicity_fm.Rows.of(rows), np.array(labels), 7)
    model = toxicity_fm.Model(18, list(range(7)), bias, w, v)
    assert model.score([0, 1, 3]) > 0.9 and max(model.score([0, 3]), model.score([1, 3])) < 0.2
    pairs = lambda f: bias + w[f].sum() + sum(v[i] @ v[j] for i in f for j in f if i < j)
    assert np.isclose(model.score([0, 1, 3]), 1 / (1 + np.exp(-pairs([0, 1, 3]))))


def test_hidden_null_types(spark):
    """All-null columns."""
    df = spark.createDataFrame([(None, None, None, None)] * 3, T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]]))
    assert token_counts.token_counts(df).count() == 3
    assert quality_mcd.quality_rules(df).where("base_failed").count() == 3
    assert packing.pack(df).count() == 3
    assert simhash_trie.near_duplicates(df).where("fp = 0").count() == 3
    assert spot_signatures.edited_and_next(df).count() == 3
    assert language_zstd.identify(df).where("lang_pred = 'und'").count() == 3
