"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, against brute force."""

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellex.llm import decontaminate, fingerprint, language_id, line_dedup, mixing, near_dedup, pii, secrets, substring_dedup, toxicity

BIG = 2**63 - 1
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(x):
    return sorted(map(repr, x))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def test_line_dedup(docs, rows, none):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(BIG if i is None else i)
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (BIG if i is None else i)]
        want.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    assert bag(got) == bag(want)
    assert line_dedup.dedup_lines(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert bag((r.doc_id, r.mx_size) for r in got) == bag((i, len(words(t))) for i, t in rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.mx_taken <= 3 * r.mx_size
        taken[r.source] += r.mx_taken
        target[r.source] = r.mx_target
        assert r.mx_target <= 3 * r.mx_source_size
    for s in taken:
        assert abs(taken[s] - target[s]) <= 0.5
    assert bag(map(tuple, got)) == bag(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()))
    assert mixing.mix_sources(none).count() == 0
    assert [mixing.bin_digits(n) for n in (0, 1, 10**6, 2**24, 10**10)] == [3, 3, 3, 3, 5]


def test_scratch_tables_go(spark, docs):
    import os

    from tessellex.llm.common import materialize, scratch

    with scratch(spark):
        (path,) = {os.path.dirname(f) for f in materialize(docs).inputFiles()}
        path = path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 30])
def test_decontaminate(spark, docs, rows, none, block_bytes):
    items = [(1, " ".join(f"ALPHA{i} beta{i % 7}" for i in range(20, 29))), (2, "two three"), (3, None), (4, ""), (2, "w7 w8"), (None, "hunter22"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w12")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for name, x in items:
            p = split(x)
            for k in range(max(1, len(p) - 9) if p else 0):
                g = p[k : k + 10]
                for a in range(len(w) - len(g) + 1):
                    if w[a : a + len(g)] == g:
                        hit |= set(range(a, a + len(g)))
                        found |= {str(name)} if name is not None else set()
        want.append((i, len(w), len(hit), sorted(found)))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(docs, b, block_bytes=block_bytes).collect()
    assert bag((r.doc_id, r.dc_n_words, sum(h.end - h.start for h in r.dc_hits), r.dc_items) for r in got) == bag(want)
    assert decontaminate.find_items(docs, b.where("false")).where("size(dc_hits) > 0").count() == 0
    assert decontaminate.find_items(none, b).count() == 0


def near_groups(rows):
    """(doc_id, shingles, component, kept) by brute force."""

    def shingles(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    want = []
    for a, (i, _) in enumerate(rows):
        c = None if i is None else min(rows[b][0] for b in range(len(rows)) if find(b) == find(a))
        want.append((i, len(sets[a]), c, i is None or c == i))
    return want


def test_near_dedup(docs, rows, none):
    assert bag(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == bag(near_groups(rows))
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    """Each text of a doc_id keeps its links: 1 has two texts, of which 2 is near to one and 3 to the other."""
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    rows = [(1, a), (1, b), (2, a.replace("a79", "x")), (3, b.replace("b79", "x")), (4, "own words of a text here"), (4, "own words of a text here"), (4, b.replace("b0 ", "y "))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(map(tuple, near_dedup.near_duplicates(d).collect())) == bag(near_groups(rows))
    first = {(r.doc_id, r.nd_first) for r in near_dedup.near_duplicates(d, keep_row=True).collect()}
    assert first == {(1, True), (2, False), (3, False), (4, True), (4, False)}


def test_near_dedup_of_a_large_bucket(spark):
    """More near copies than a small bucket holds, so that blocks join them."""
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i, k in ((i, 5 * i) for i in range(60))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.nd_component for r in got} == {0}
    assert sum(r.nd_kept for r in got) == 1


def repeats(rows):
    """(doc_id, bytes, removed bytes, runs, kept bytes) by brute force."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, BIG), BIG if i is None else i)
    want = []
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (BIG if i is None else i):
                gone |= set(range(p, p + 50))
        want.append((i, len(b), len(gone), sum(p - 1 not in gone for p in gone), bytes(b[p] for p in range(len(b)) if p not in gone)))
    return want


def removed(d, **how):
    return [(r.doc_id, r.sd_n_bytes, sum(s.end - s.start for s in r.sd_spans), len(r.sd_spans), bytes(r.sd_kept)) for r in substring_dedup.remove_repeats(d, **how).collect()]


def test_substring_dedup(docs, rows, none):
    assert bag(removed(docs)) == bag(repeats(rows))
    assert substring_dedup.remove_repeats(none).count() == 0


def random_passages(seed, ids):
    """Texts of shared passages and of own words."""
    rng = random.Random(seed)
    own = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 9))) for _ in range(n))
    shared = [own(14) for _ in range(12)]
    return [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else own(12) for _ in range(rng.randint(0, 6)))) for i in ids]


def test_substring_dedup_of_null_and_repeated_ids(spark):
    """A thousand null ids and ids that come with several texts: rows are told apart by more bits than few."""
    rows = random_passages(1, [None] * 1000 + [k % 150 for k in range(600)])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(removed(d)) == bag(repeats(rows))
    nulls = rows[:1000] + random_passages(2, range(50))
    assert bag(removed(spark.createDataFrame(nulls, "doc_id long, text string"))) == bag(repeats(nulls))


@pytest.mark.parametrize("fan", [3, 40])
def test_substring_dedup_in_rounds(spark, fan):
    """Several rounds of few buckets each give what one round gives."""
    assert substring_dedup.rounds(1, 4) == [1] and substring_dedup.rounds(17, 4) == [3, 3, 3] and substring_dedup.rounds(4096, 4096) == [4096]
    rows = random_passages(3, [*range(300), *range(0, 300, 7)]) + [(400, "x" * 700), (401, "y" + "x" * 300)]
    assert bag(removed(spark.createDataFrame(rows, "doc_id long, text string"), block=2000, fan=fan)) == bag(repeats(rows))


def test_substring_dedup_of_a_very_long_text(spark):
    """A text that is read in pieces: what it repeats lies across their edges."""
    rng = random.Random(4)
    step = substring_dedup.STEP
    own = "".join(rng.choices("abcdefghijklmnop", k=4 * step + 9000))
    short = [own[at - 40 : at + 60] for at in (step, 2 * step, 4 * step)]
    rows = [(1, short[0]), (2, short[1]), (3, own), (4, short[2]), (5, own[:200])]
    got = {r.doc_id: [tuple(s) for s in r.sd_spans] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [(step - 40, step + 60), (2 * step - 40, 2 * step + 60)], 4: [(0, 100)], 5: [(0, 200)]}


def test_suffix_sort():
    import numpy as np

    data = np.frombuffer(b"abcabcabc" * 30 + b"abdabc" * 20 + b"\0" * 80, np.uint8)
    at = np.arange(len(data) - 80)
    got, common = substring_dedup.suffix_sort(data, at, substring_dedup.Hashes(data, substring_dedup.Powers()))
    cut = [data[p : p + 50].tobytes() for p in got]
    assert cut == sorted(cut) and sorted(got) == at.tolist()
    assert [c == 50 for c in common[1:]] == [a == b for a, b in zip(cut, cut[1:], strict=False)]


def shingle_set(t):
    w = words(t)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_fingerprint(docs, rows, none):
    """Whatever the order among equal ids is: every text has the right follower's half."""
    import hashlib

    got = fingerprint.fingerprint_and_compare(docs).collect()
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[-(2**63) if i is None else i].append(t or "")
    order = sorted(by_id, reverse=True)
    after = {i: {t for j in (i, order[(k + 1) % len(order)]) for t in by_id[j]} if len(by_id[i]) > 1 else set(by_id[order[(k + 1) % len(order)]]) for k, i in enumerate(order)}
    digest = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert bag((r.doc_id, r.fp_n_chars) for r in got) == bag((i, len(t or "")) for i, t in rows)
    for r in got:
        i = -(2**63) if r.doc_id is None else r.doc_id
        assert r.fp_edited_sha256 in {digest(t, n) for t in by_id[i] if len(t) == r.fp_n_chars for n in after[i]}
    sketch = {r.doc_id: r.fp_sketch for r in got}
    assert sketch[1] == sketch[2] == sketch[4] and sketch[1]
    assert sketch[7] == sketch[8] == sketch[9] == []
    assert {r.doc_id for r in got if r.fp_least is None} == {7, 8, 9}
    assert all(0 <= x <= 1 for r in got for x in (r.fp_near_edited, r.fp_near_next, r.fp_inside_edited, r.fp_inside_next))
    assert fingerprint.fingerprint_and_compare(none).count() == 0
    assert fingerprint.fingerprint_and_compare(docs.where("doc_id = 1")).head().fp_near_next == 1.0


def test_fingerprint_ranges(spark):
    """Null ids and one repeated id are a third of all rows each, and more than one range has some of them."""
    import hashlib

    rows = [(None, f"null text {k} of its own") for k in range(400)] + [(7, f"repeated text {k} of its own") for k in range(400)] + [(100 + k, f"text {k} of its own") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = fingerprint.with_next(d).where("fp_guest = 0").select("fp_bucket", F.spark_partition_id().alias("p"), "doc_id").toPandas()
    assert ranges.groupby("fp_bucket").size().max() < 300 and ranges.groupby("p").fp_bucket.nunique().max() == 1
    assert ranges[ranges.doc_id.isna()].fp_bucket.nunique() > 1 and ranges[ranges.doc_id == 7].fp_bucket.nunique() > 1
    got = fingerprint.fingerprint_and_compare(d).collect()
    assert len(got) == 1200
    text = dict(rows[800:])
    want = {i: hashlib.sha256((text[i][: len(text[i]) - len(text[i]) // 2] + text[i - 1][: len(text[i]) // 2]).encode()).hexdigest() for i in range(101, 500)}
    assert {r.doc_id: r.fp_edited_sha256 for r in got if (r.doc_id or 0) > 100} == want


def test_sketches_merge_and_estimate(spark):
    """Unions of sketches are sketches of unions; estimates of all of sf0.01 against the true values of whole shingle sets."""
    import numpy as np
    from tessellex.llm.common import Shingler

    a, b = " ".join(f"a{i}" for i in range(300)), "only two"
    shingler = Shingler()
    (x, y, z), least = fingerprint.sketches(pa.array([a, b, ""]), shingler)
    both, _ = shingler(pa.array([a, b]))
    assert np.array_equal(fingerprint.merge([x, y, z]), np.unique(both[both < np.uint64(2**62)] >> np.uint64(16))) and len(least[1]) == 1 and not len(least[2])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    errors = []
    for r in fingerprint.fingerprint_and_compare(docs).collect():
        t, n = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        own, edited = shingle_set(t), shingle_set(t[: len(t) - half] + n[:half])
        truth = len(own & edited) / len(own | edited) if own | edited else 1.0
        errors.append((abs(r.fp_near_edited - truth), len(own | edited)))
    assert np.mean([e for e, _ in errors]) < 0.05
    assert all(e < 4.5 * math.sqrt(3 * 0.25 / n) for e, n in errors if n >= 100)  # 4.5 standard errors of a share at one in four


def test_language_id(spark, docs, none):
    text = {"aa": "the cat and the dog sat on the mat " * 30, "bb": "der hund und die katze sind auf dem dach " * 30}
    train = spark.createDataFrame([(i, t, la) for i in range(20) for la, t in text.items()] + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_id.learn(train.select("*", *[F.lit(0).alias(c) for c in ("li_limit", "n", "h")]))
    test = spark.createDataFrame([(1, "the cat sat"), (2, "die katze"), (3, None), (4, "12 !"), (5, ""), (6, "the cat and " * 9000), (6, "the cat and " * 9000), (None, "und der hund")], "doc_id long, text string")
    got = [tuple(r)[:2] for r in language_id.identify(test, model).collect()]
    assert bag(got) == bag([(1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "aa"), (6, "aa"), (None, "bb")])
    assert language_id.identify(docs, language_id.learn(train.where("false"))).where("li_lang <> 'und'").count() == 0
    assert language_id.identify(none, model).count() == 0


def test_language_of_long_documents_only(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 30, "aa") for i in range(20)] + [(i, "der hund und die katze sind auf dem dach " * 600, "bb") for i in range(20, 23)] + [(30, "", "bb")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the cat sat"), (2, "die katze")], "doc_id long, text string")
    assert {r.doc_id: r.li_lang for r in language_id.identify(test, model).collect()} == {1: "aa", 2: "bb"}


@pytest.mark.parametrize(("alphabet", "lane"), [(3, 16), (3, 512), (2000, 64), (1, 32)])
def test_phrases_are_longest_matches(alphabet, lane):
    """Over small and large alphabets and periodic texts, with phrases longer than a lane."""
    import numpy as np

    rng = np.random.default_rng(alphabet)
    learned = rng.integers(0, alphabet, 900)
    texts = [rng.integers(0, alphabet + 1, n) for n in (0, 1, 700)] + [np.concatenate([learned[a : a + n] for a, n in ((3, 80), (100, 300), (50, 200), (400, 3))]), np.tile(learned[:5], 90), learned]
    hay, want = learned.astype(np.uint16).tobytes().decode("utf-16-le"), []
    for x in texts:
        read, n, i = x.astype(np.uint16).tobytes().decode("utf-16-le"), 0, 0
        while i < len(read):
            k = 1
            while i + k <= len(read) and read[i : i + k] in hay:
                k += 1
            i += max(1, k - 1)
            n += 1
        want.append(n)
    ends = np.cumsum([len(x) for x in texts])
    step = language_id.Automaton(learned, alphabet + 1)
    assert language_id.phrases(np.concatenate(texts), ends - [len(x) for x in texts], ends, step, lane).tolist() == want


def test_languages_of_large_alphabets(spark):
    """Two made languages of 2,000 ideographs each, 500 of them shared."""
    rng = random.Random(6)
    letters = {"aa": range(0x4E00, 0x4E00 + 2000), "bb": range(0x4E00 + 1500, 0x4E00 + 3500)}
    words = {la: ["".join(chr(rng.choice(x)) for _ in range(rng.randint(1, 3))) for _ in range(1500)] for la, x in letters.items()}
    rows = [(i, " ".join(rng.choices(words[la], k=120)), la) for i, la in enumerate(["aa", "bb"] * 150)]
    model = language_id.learn(spark.createDataFrame(rows[:200], "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame(rows[200:], "doc_id long, text string, lang string"), model).collect()
    assert sum(r.li_lang == rows[r.doc_id][2] for r in got) >= 0.99 * len(got)


def test_secrets(docs, rows, none):
    pattern = re.compile(secrets.ASSIGN, re.A)
    want = []
    for i, t in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[1]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.append((i, sorted(s)))
    got = secrets.scan_secrets(docs).collect()
    assert bag((r.doc_id, [tuple(s) for s in r.sc_base]) for r in got) == bag(want)
    assert all({tuple(s) for s in r.sc_base} <= {tuple(s) for s in r.sc_spans} for r in got)
    assert secrets.scan_secrets(none).count() == 0


def test_secrets_beyond_the_patterns(spark):
    text = "see the long-identifier-of-a-variable and é zX9qLw3RtY7uPk2VbN8mQ1 there\n" + "word " * 300
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = secrets.scan_secrets(d).collect()
    assert [text[s.start : s.end] for s in r.sc_spans] == ["zX9qLw3RtY7uPk2VbN8mQ1"]


#: Fifty ordinary identifiers of sixteen symbols or more.
IDENTIFIERS = """
    HttpRequestHandlerFactoryV2Builder /usr/lib/python3/dist-packages/numpy2x/core getUserNameById2FromCache sha256_checksum_of_file_v2
    AbstractSingletonProxyFactoryBean java/util/concurrent/ConcurrentHashMap org_apache_spark_sql_catalyst spark-3_5_1-bin-hadoop3
    node_modules/lodash/lib/index_v4 MAX_RETRIES_PER_HOST_V2 base64_encode_url_safe utf8mb4_unicode_ci_0900 x86_64-unknown-linux-gnu
    i18n_locale_en_US_utf8 test_case_0042_failure 2024-01-15-release-notes http2_stream_window_size IPv6AddressParser2Test convert_h264_to_mp4_file
    /home/user1/projects/app2/src/main EC2InstanceConnectEndpoint S3BucketPolicyManager2 md5sum_of_archive_v3 log4j2-spring-boot-starter
    OAuth2TokenRequestHandler K8sPodAutoscalerV2beta1 vertex_shader_330_core mp3_to_wav_converter_2 RFC2822DateTimeFormat Win32_OperatingSystem
    index_of_column_b12_in_table user_profile_picture_url2 getElementsByClassName0 React18ConcurrentMode com/google/common/collect
    x509_certificate_chain setUp2DTextureArray vulkan_1_3_feature_flags e2e_integration_tests_v1 sys_admin_panel_v2_beta customer_id_2_order_id
    JpaRepositoryConfigV1 blake2b_hash_function_512 py310_linux_x86_64_wheel cuda11_8_cudnn8_runtime Jsr310DateTimeConverters config-v1alpha1-schema
    aes256_gcm_no_padding Utf16LittleEndianDecoder a11y_color_contrast_check4
""".split()


def test_identifiers_are_no_secrets_and_random_strings_are(spark):
    """Precision and recall of what the models add, learned from texts of which none is here."""
    import base64
    import string

    rng = random.Random(3)
    pick = lambda of, k: "".join(rng.choices(of, k=k))
    kinds = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    secret = [pick(of, rng.randint(18, 40)) for of in kinds for _ in range(60)] + [base64.b64encode(rng.randbytes(24)).decode() for _ in range(60)] + [rng.randbytes(11).hex() for _ in range(60)]
    texts = [f"call {x} there" for x in IDENTIFIERS + secret]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in secrets.scan_secrets(d, train=spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("size(sc_spans) > size(sc_base)").collect()}
    assert len(IDENTIFIERS) == 50 and sum(i in got for i in range(50)) <= 1
    assert sum(i in got for i in range(50, len(texts))) >= 0.95 * len(secret)


def test_runs_that_touch_spans_are_left_out(spark):
    """Binary search against all pairs, in a text of many runs and spans of every kind."""
    rng = random.Random(11)
    pick = lambda of, k: "".join(rng.choices(of, k=k))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = [lambda: pick(alnum, 24), lambda: pick("0123456789abcdef", 40), lambda: "AKIA" + pick(alnum[:26] + alnum[-10:], 18), lambda: 'token: "' + pick(alnum, 12) + '"', lambda: "zz" + pick("0123456789abcdef", 30) + "QX" + pick(alnum, 9), lambda: "word"]
    texts = ["", " ".join(rng.choice(parts)() for _ in range(1500)), "é " + " ".join(rng.choice(parts)() for _ in range(7))]
    for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        more = [s for s in r.sc_spans if s.kind == 3]
        assert [tuple(s) for s in r.sc_spans if s.kind < 3] == [tuple(s) for s in r.sc_base]
        assert not any(b.start < s.end and s.start < b.end for s in more for b in r.sc_base)
        plain = [m for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", texts[r.doc_id]) if not any(b.start < m.end() and m.start() < b.end for b in r.sc_base)]
        assert [(s.start, s.end) for s in more] == [m.span() for m in plain]


def test_many_spans_have_right_positions(spark):
    text = "é token=abcdef1 " * 500
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = d.select(F.explode(secrets.base_spans(F.col("text"))).alias("s")).select("s.start", "s.end").collect()
    assert [tuple(r) for r in got] == [(16 * i + 2, 16 * i + 15) for i in range(500)]


def test_pii(docs, none):
    r = {x.doc_id: x for x in pii.find_pii(docs).collect()}
    assert [s.kind for s in r[17].pi_base] == [3, 0, 1, 2]
    assert r[7].pi_spans == r[8].pi_spans == []
    assert pii.find_pii(docs).count() == docs.count()
    assert pii.find_pii(none).count() == 0
    kept = pii.find_pii(docs, keep=("text", "pi_row", "value"))
    assert kept.columns == ["doc_id", "text", "pi_row", "value", "pi_base", "pi_spans"] and kept.where("doc_id = 8").head().text == ""


def test_pii_base_spans_of_all_documents(spark):
    """All of sf0.01 and texts that are near misses, against the patterns as they stand in the contract."""

    def passes_luhn(d):
        twice = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
        return (sum(twice) + sum(d[-1::-2])) % 10 == 0

    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out)

    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["".join(rng.choices("a1.@-+ (0)255é", k=60)) for _ in range(3000)]
    assert all(pii.base_spans(t or "") == base(t or "") for t in texts)


def test_pii_reads_texts_in_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        pii.occurrences(pa.RecordBatch.from_pydict({"text": pa.array(["x @ a.b@ 12.3@ token: abcd1 " * n])}))
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 20 * took(2_000) + 1


def test_pii_values_of_keys(spark):
    """A word that introduces seeds introduces other identifiers, also without digits; credentials and words that introduce no seeds don't count."""
    key = [(i, f'text {i} has contact = "{chr(97 + i)}fwqh@zzkl.org" and more') for i in range(6)]
    new = [(10 + i, f'file {i} with contact = "{chr(97 + i)}wqh.zzkl" in it') for i in range(4)]
    d = spark.createDataFrame([*key, *new, (31, "the shelf 22-aaaa.x1 fell"), (32, 'note: something and size = "large"'), (33, 'contact: token = "abcd-efgh-1234"'), (34, 'token = "ghij.klmn"')], "doc_id long, text string")
    r = {x.doc_id: [x.text[s.start : s.end] for s in x.pi_spans] for x in pii.find_pii(d, keep=("text",)).collect()}
    assert r[3] == ["dfwqh@zzkl.org"] and [r[10 + i] for i in range(4)] == [[f"{chr(97 + i)}wqh.zzkl"] for i in range(4)]
    assert r[31] == r[32] == r[33] == r[34] == []


def test_pii_discovers_planted_identifiers(spark):
    """Identifiers of unseen kinds in the contexts of seeds, among texts with identifiers of no person: recall and precision of 0.8, through patterns alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("bcdlmnrstaeiou", k=rng.randint(3, 9)))
    fill = lambda n: " ".join(word() for _ in range(n))
    contexts = ["please reach me at {} before", "you may call {} after", "my contact: {} since", "send it to {} by", "write back under {} or"]
    seeds = [lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.org", lambda: f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))]
    unseen = [lambda: f"@{word()}_{rng.randint(1, 99)}", lambda: f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: f"EMP-{rng.randint(1000, 9999)}-{word()}", lambda: f"{word()}.{word()}{rng.randint(1, 9)}"]
    other = ["version {} was built", "see section {} below", "order {} shipped today", "the file {} is large"]
    things = [lambda: f"{rng.randint(1, 9)}.{rng.randint(1, 20)}.{rng.randint(1, 20)}", lambda: f"{word()}-{rng.randint(100, 9999)}", lambda: f"{word()}_{word()}.txt"]
    rows, planted = [], set()
    for i in range(400):
        kind, place = ("seed", contexts) if i % 8 < 3 else ("new", contexts) if i % 8 < 5 else ("thing", other)
        value = rng.choice({"seed": seeds, "new": unseen, "thing": things}[kind])()
        text = f"{fill(8)} {rng.choice(place).format(value)} {fill(8)}"
        rows.append((i, text))
        if kind == "new":
            planted.add((i, text.index(value), text.index(value) + len(value)))
    got = {(r.doc_id, s.start, s.end) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.pi_spans if s.kind == 4}
    assert len(got & planted) >= 0.8 * len(planted) and len(got & planted) >= 0.8 * len(got) > 0


def test_pii_bootstraps_contexts(spark):
    seeds = [(i, f"please write to user{i}@example.org now") for i in range(6)]
    d = spark.createDataFrame([*seeds, (50, "please write to handle-4471-x now"), (51, "order 4471-4472-x shipped")], "doc_id long, text string")
    r = {x.doc_id: x.pi_spans for x in pii.find_pii(d, min_score=0.5).collect()}
    assert [(s.start, s.kind, s.end) for s in r[50]] == [(16, 4, 29)]
    assert r[51] == []


def test_toxicity(spark, docs, none):
    rows = [(i, "you are a " + ("horrible moron today" if i % 5 == 0 else "nice person today") + " ".join(f" own{i * k}" for k in range(2, 20))) for i in range(1, 401)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(d, labels)
    test = [(1, "a horrible moron"), (2, "a horible morron thing"), (3, "nice person"), (4, None), (5, ""), (5, ""), (None, "horrible moron"), (6, 'they said "horrible moron" in a quote')]
    got = bag((r.doc_id, r.tx_score >= 0.5) for r in toxicity.score_toxicity(spark.createDataFrame(test, "doc_id long, text string"), model).collect())
    assert got == bag([(1, True), (2, True), (3, False), (4, False), (5, False), (5, False), (None, True), (6, False)])
    empty = toxicity.learn(d, labels.where("false"))
    assert toxicity.score_toxicity(docs, empty).where("tx_score >= 0.5").count() == 0
    assert toxicity.score_toxicity(none, model).count() == 0


def test_misspelled_and_quoted_terms(spark):
    """Learned without misspelled or quoted terms; held-out texts with only such ones."""
    rng = random.Random(8)
    terms = ["worthless", "disgusting", "pathetic", "moron", "horrible", "stupid"]
    fill = lambda: ["".join(rng.choices("bcdglnrsaeiou", k=rng.randint(3, 8))) for _ in range(40)]

    def text(put):
        w = fill()
        for x in put:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    def misspelled(t):
        k = rng.randrange(1, len(t) - 1)
        edits = [t[:k] + t[k + 1 :], t[:k] + rng.choice("xqz") + t[k:], t[:k] + rng.choice("xqz") + t[k + 1 :]]
        return rng.choice([*edits, t[:k] + t[k + 1] + t[k] + t[k + 2 :]] if len(t) >= 9 else edits)

    train = [(i, text(rng.choices(terms, k=3) if i % 8 == 0 else [])) for i in range(2000)]
    d = spark.createDataFrame(train, "doc_id long, text string")
    model = toxicity.learn(d, d.select("doc_id", (F.col("doc_id") % 8 == 0).cast("int").alias("toxic")))
    assert set(terms) <= set(model["terms"])
    bad = [(i, text([misspelled(t) for t in rng.sample(terms, 3)])) for i in range(300)]
    quoted = [(i, text([f'"{a} {b}"']) + " ") for i, (a, b) in ((i, rng.sample(terms, 2)) for i in range(300, 400))]
    clean = [(i, text([])) for i in range(400, 900)]
    got = {r.doc_id: r.tx_score for r in toxicity.score_toxicity(spark.createDataFrame(bad + quoted + clean, "doc_id long, text string"), model).collect()}
    assert sum(got[i] >= 0.5 for i in range(300)) >= 0.9 * 300
    assert all(got[i] < 0.5 for i in range(300, 400))
    assert sum(got[i] < 0.5 for i in range(400, 900)) >= 0.99 * 500


def test_quotes_are_counted_by_line():
    finder = toxicity.Finder(["moron"], frozenset())
    text = 'a "moron" moron "\nmoron "x" moron " moron\n"\n moron'
    assert [h[4] for h in finder(text)] == [True, False, False, False, True, False]
    many = finder('" moron ' * 60_000)
    assert [h[4] for h in many[:4]] == [True, False, True, False] and len(many) == 60_000


def test_matcher_is_levenshtein():
    from itertools import product

    m = toxicity.Matcher(["moron", "stupid", "scum", "stem*"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for n in range(3, 7):
        for w in map("".join, product("moru", repeat=n)):
            assert (m.find(w) is not None) == (distance(w, "moron") <= 1), w
    assert m.find("stupyd") == ("stupid", 1) and m.find("scam") is None and m.find("stemming") == ("stem*", 0)


@pytest.mark.parametrize(("token", "term"), [("wrothless", "worthless"), ("disgsuting", "disgusting")])
def test_long_terms_allow_two_edits(token, term):
    m = toxicity.Matcher(["worthless", "disgusting", "horrible"])
    assert m.find(token) == (term, 2)
    assert m.find("hrorible") is None


def test_words_keep_their_edits_beside_a_stem():
    for stem in ("idio*", "idiot*"):
        terms = toxicity.choose([(stem, 12), ("idiot", 11), ("idiots", 2), ("idiotic*", 2)])
        assert sorted(terms) == sorted([stem, "idiot", "idiots"])
        for order in (terms, terms[::-1]):
            m = toxicity.Matcher(order)
            assert m.find("ideot") == m.find("idot") == ("idiot", 1)
            assert m.find("idiotz") == (stem, 0) and m.find("idea") is None


def test_misspelled_words_of_a_stem_are_hits(spark):
    """A toxic document more has an inflected form, so that a stem comes before the word."""
    own = lambda i: " ".join(f" own{i * k}" for k in range(2, 20))
    insult = lambda i: "idiots" if i == 400 else "idiot"
    d = spark.createDataFrame([(i, f"you are a {insult(i) if i % 5 == 0 else 'nice person'} today {own(i)}") for i in range(1, 401)], "doc_id long, text string")
    model = toxicity.learn(d, d.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")))
    assert "idiot" in model["terms"] and any(t.endswith("*") and "idiots".startswith(t[:-1]) for t in model["terms"])
    test = spark.createDataFrame([(1, "you ideot"), (2, "you idot"), (3, "you idiots"), (4, "you there")], "doc_id long, text string")
    assert {r.doc_id: [h.edits for h in r.tx_hits] for r in toxicity.score_toxicity(test, model).collect()} == {1: [1], 2: [1], 3: [0], 4: []}


def test_near_dedup_blocks_of_large_buckets(spark):
    """Buckets of several blocks, with chains, strays and texts just below the threshold, against brute force."""
    from tessellex.llm.near_dedup import near_duplicates

    rng = random.Random(5)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(260):  # one large group at different distances, some of it out of reach
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 % 263, " ".join(words)))
    words = list(base)
    for i in range(40):  # a chain that leads away from it
        words[i * 3] = f"y{i}"
        rows.append((1000 + i, " ".join(words)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=20).collect()
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    want = {d: find(d) for d in sets}
    assert len(set(want.values())) > 3
    assert {r["doc_id"]: r["nd_component"] for r in found} == want


def test_kept_columns_of_any_name(spark, docs, none):
    """Kept columns that an operator makes or reads itself come back as they were, beside its results."""
    d = docs.select("doc_id", "text", "source", *[F.concat(F.lit("kept "), F.col("doc_id").cast("string")).alias(c) for c in ("sc_text", "sc_base", "mx_size", "mx_order", "ld_id", "ld_text", "dc_hits", "li_lang", "tx_score")])
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    toxic = toxicity.learn(d, d.where("false").select("doc_id", F.lit(1).alias("toxic")))
    runs = [
        (secrets.scan_secrets, (), ("sc_text", "sc_base", "doc_id"), 1), (mixing.mix_sources, (), ("mx_size", "mx_order", "source"), 2), (line_dedup.dedup_lines, (), ("ld_id", "ld_text", "text"), 1),
        (decontaminate.find_items, (items,), ["dc_hits", "doc_id"], 0), (language_id.identify, (language_id.learn(d.withColumn("lang", F.lit("en"))),), ["li_lang", "doc_id"], 0), (toxicity.score_toxicity, (toxic,), ["tx_score", "doc_id"], 0),
    ]
    for operator, args, keep, at in runs:
        plain = operator(d, *args)
        if at == 0:
            plain = plain.drop("doc_id")
        got = operator(d, *args, keep=keep)
        want = d.select(*keep)
        assert got.columns == [*plain.columns[:at], *keep, *plain.columns[at:]]
        rows = got.collect()
        assert bag(tuple(r)[at : at + len(keep)] for r in rows) == bag(map(tuple, want.collect()))
        assert bag((*tuple(r)[:at], *tuple(r)[at + len(keep) :]) for r in rows) == bag(map(tuple, plain.collect()))
        assert operator(d.where("false"), *args, keep=keep).count() == 0
