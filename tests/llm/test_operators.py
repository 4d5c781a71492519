"""Every text operator against a plain version, and on odd rows, no rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import (  # noqa: E402
    LONG, ODD_ROWS, frame, linked_components, near_copies, nothing, odd, repeats_removed, shingle_set, words,
)

from sarmotion.llm import (  # noqa: E402
    components, decontamination, exact_dedup, idfilter, language_id, lm_scoring, near_dedup, packing, pii, sharding,
    substring_dedup, toxicity,
)
from sarmotion.llm.common import crc_mod, text_buffer  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1 language id ---------------------------------------------------------------------------


def test_language_id_is_right_on_rows_it_has_not_seen(docs):
    held = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    found = language_id.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == docs.where(held).count()
    assert sum(r["rejected"] for r in found) <= 0.03 * len(found)


def test_language_scores_equal_a_plain_computation(docs, texts):
    model = language_id.fit(docs)
    chosen = [t for t in list(texts.values())[:12] if t] + ["Ab", "x", "ÄÖ wort"]
    data, offsets = text_buffer(pa.array(chosen))
    found, common = language_id.scores(model, data, offsets)
    k = len(model.names)
    for text, p, enough in zip(chosen, found, common):
        raw = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in text.encode())
        grams = [raw[i : i + size] for size in language_id.SIZES for i in range(len(raw) - size + 1)]
        total = np.zeros(2 * k)
        for gram in grams:
            key = len(gram)
            for c in gram:
                key = (key << 8 | c) % (1 << 32)
            total += model.table[(key * 0x9E3779B1) % (1 << 32) >> 16]
        total /= len(grams)
        z = np.exp((total[:k] + model.bias) / model.temperature - ((total[:k] + model.bias) / model.temperature).max())
        assert p == pytest.approx(z / z.sum(), abs=1e-4)
        assert enough == (total[k:].max() + language_id.SLACK / len(grams) ** 0.5 >= model.least_common)


def test_language_rejects_what_is_no_known_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    letters = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(400))
    code = Path(language_id.__file__).read_text()
    strange = [letters("abcdefghijklmnopqrstuvwxyz ") for _ in range(20)] + [letters("αβγδεζηθικλμνξοπρστ ") for _ in range(20)]
    strange += [code[i : i + 600] for i in range(0, 6000, 600)]
    model = language_id.fit(docs)
    found = language_id.identified(frame(spark, list(enumerate(strange))), model)
    assert found.where("rejected").count() >= 0.95 * len(strange)
    for left in ("de", "fr"):
        blind = language_id.fit(docs.where(F.col("lang") != left))
        share = lambda rows: language_id.identified(rows, blind).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        assert share(docs.where(F.col("lang") == left)) > 0.8
        assert share(docs.where(F.col("lang") != left)) < 0.03


def test_language_id_prediction_reads_nothing_but_the_text(docs):
    model = language_id.fit(docs)
    plain = by_id(language_id.identified(docs, model))
    blind = by_id(language_id.identified(docs.withColumn("lang", F.lit(None).cast("string")), model))
    assert plain == blind


def test_language_id_odd_rows(spark):
    model = language_id.fit(odd(spark))
    found = language_id.identified(odd(spark), model).collect()
    assert len(found) == len(ODD_ROWS)
    letters = {1: False, 2: False, 3: False, 7: False, 4: True, 6: True, 8: True, 11: True}
    for r in found:
        if r["doc_id"] in letters:
            assert (r["lang_pred"] != "und") == letters[r["doc_id"]]
            assert letters[r["doc_id"]] or (r["rejected"] and r["score"] == 0)
    assert language_id.accepted(odd(spark), model).count() == sum(not r["rejected"] for r in found)
    assert language_id.accepted(odd(spark), model).columns == odd(spark).columns
    assert language_id.fit(nothing(spark)) is None
    assert language_id.identified(nothing(spark), model).count() == 0
    untaught = language_id.identified(odd(spark), None).where("doc_id in (1, 4)").orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["rejected"]) for r in untaught] == [("und", True), ("und", False)]


# ---- 2 personal data -------------------------------------------------------------------------

PLAIN_KINDS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(x) <= 255 for x in match.split("."))
    if kind == 2:
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(d) <= 15


def plain_spans(text):
    return [
        (k, m.start(), m.end()) for k, p in enumerate(PLAIN_KINDS) for m in re.finditer(p, text or "") if holds(k, m.group())
    ]


HARD = [
    "a@b.c_x@d.e a.b@c-d.org. x@@y.zz @q.w %@a.b..c é@ü.de a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 10.0.0.01 1.2.3x4.5.6.7",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 12 4111  1111 5500000000000004", "+49 (30) 123-45.67 8 +1 2 ++12345678901 +1234567890123456 +12 345 678 9)",
    "ä" * 5 + " bob@example.com 192.168.0.1 +491234567890", "9" * 3000, "a" * 30_000, "1." * 3000, "+1" + "." * 5000,
]


def test_personal_data_equals_a_plain_scan(spark, texts):
    rows = list(texts.items()) + [(10_000 + k, t) for k, t in enumerate(HARD)]
    found = by_id(pii.personal_data(frame(spark, rows)))
    for i, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in found[i]["spans"]] == plain_spans(text), text[:200]


def test_terms_that_always_stand_by_an_entity_are_found(spark):
    rows = [(k, f"Call Rumpelstilz at ann@spin.org now {k}") for k in range(5)]
    rows += [(100 + k, f"now call somebody at the office {'abc' * k}") for k in range(60)]
    found = by_id(pii.personal_data(frame(spark, rows)))
    for k in range(5):
        text = rows[k][1]
        marked = {text[t["start"] : t["end"]]: t["remove"] for t in found[k]["terms"]}
        assert marked.get("Rumpelstilz") is True and "Call" not in marked and "now" not in marked
    assert all(not found[100 + k]["terms"] for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows), pii.personal_data(frame(spark, rows))).collect()}
    assert clean[0] == "Call  at [EMAIL] now 0" and clean[100] == rows[5][1]


def test_disclosure_ratio_is_that_of_the_definition(spark):
    rows = [(k, "zorro a@b.cd") for k in range(4)] + [(10 + k, "zorro alone") for k in range(4)] + [(20 + k, "other words") for k in range(24)]
    df = frame(spark, rows)
    base = pii.base_spans(df)
    got = {(r["entity"], r["term"]): r["ratio"] for r in pii.disclosing_terms(df, pii._neighbours(base), base, least=0.0).collect()}
    assert got[("email:a@b.cd", "zorro")] == pytest.approx(math.log(32 * 4 / (8 * 4)) / math.log(32 / 4))


def test_terms_of_a_single_document_are_found_and_copies_count_once(spark):
    rows = [(1, "Call Rumpelstilz at ann@spin.org now")]
    # Forty copies of one text are one document: their common word stays common.
    rows += [(10 + k, "mail the usual letters to bob@spin.org now") for k in range(40)]
    rows += [(100 + k, f"now call the usual office {'abc' * k}") for k in range(60)]
    found = by_id(pii.personal_data(frame(spark, rows)))
    words = lambda i, text: {text[t["start"] : t["end"]] for t in found[i]["terms"]}
    assert words(1, rows[0][1]) == {"Rumpelstilz"}
    assert all(words(10 + k, rows[1][1]) == {"mail", "letters"} for k in range(40))
    assert all(not found[100 + k]["terms"] for k in range(60))


def test_telling_terms_are_marked_far_from_the_entity_and_whatever_their_form(spark):
    far = "the usual words of this office " * 40
    text = f"Rumpelstilz-Meyer: AB1234 {far} id=QX77 {far} ann@spin.org,+49123456789-Zwerg and RUMPELSTILZ-MEYER"
    rows = [(1, text)] + [(100 + k, f"the usual words of this office and {'abc' * k}") for k in range(60)]
    found = by_id(pii.personal_data(frame(spark, rows)))
    marked = [text[t["start"] : t["end"]] for t in found[1]["terms"]]
    assert marked == ["Rumpelstilz-Meyer", "AB1234", "QX77", "-Zwerg", "RUMPELSTILZ-MEYER"]
    assert all(not found[100 + k]["terms"] for k in range(60))


def test_personal_data_plans_no_python(docs):
    text = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_personal_data_odd_rows(spark):
    found = pii.personal_data(odd(spark)).collect()
    assert len(found) == len(ODD_ROWS) and all(not r["spans"] and not r["terms"] for r in found)
    assert pii.personal_data(nothing(spark)).count() == 0


# ---- 3 exact dedup ---------------------------------------------------------------------------


def plain_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        digest = hashlib.sha256((t or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)}).encode()).hexdigest()
        groups[digest].append((-len(t or ""), i is None, i if i is not None else 0))
    out = collections.Counter()
    for digest, members in groups.items():
        keep = min(members)
        keep = None if keep[1] else keep[2]
        for _, missing, i in members:
            i = None if missing else i
            out[(i, keep, len(members), i == keep, digest)] += 1
    return out


@pytest.mark.parametrize("counters", [2, 4, 1024])
def test_exact_dedup_equals_a_plain_grouping(spark, texts, counters):
    rows = list(texts.items()) + [(5000 + k, "hot copy " + " " * (k % 7)) for k in range(200)] + ODD_ROWS
    found = exact_dedup.exact_duplicates(frame(spark, rows).repartition(5), counters=counters)
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect())
    assert got == plain_exact(rows)
    assert exact_dedup.exact_duplicates(nothing(spark)).count() == 0


def test_misra_gries_misses_no_frequent_digest(spark):
    values = ["hot"] * 400 + [f"v{k}" for k in range(600)] + ["warm"] * 150
    df = spark.createDataFrame([(v,) for v in values], "text_sha256 string").repartition(6)
    found = {r[0] for r in exact_dedup.frequent_digests(df, counters=16).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 16


# ---- 4 language-model scores -----------------------------------------------------------------


def plain_base(rows, trained):
    count = collections.Counter()
    for i, t in rows:
        if trained(i):
            count.update([*words(t, True), None])
    n, v = sum(count.values()), len(count)
    return n, {
        i: (len(w := [*words(t, True), None]), sum(count[x] > 0 for x in w),
            sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        for i, t in rows
    }


@pytest.mark.parametrize("share", [4, 19])
def test_base_score_equals_a_plain_count(spark, texts, share, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORD_SHARE", share)
    rows = list(texts.items())
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    df = frame(spark, rows).withColumn("trained", crc_mod("doc_id", 5) != 1)
    found = by_id(lm_scoring.scored(df, trained_col="trained"))
    n, expected = plain_base(rows, trained)
    for i, (tokens, known, score) in expected.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)


def plain_tree(texts, depth):
    """The weighted probability of each byte by recursion over counts, all contexts kept."""
    counts = [collections.defaultdict(lambda: np.zeros(256)) for _ in range(depth + 1)]
    for t in texts:
        raw = bytes([lm_scoring.START] * depth) + (t or "").encode().lower() + bytes([lm_scoring.END])
        for at in range(depth, len(raw)):
            for d in range(depth + 1):
                counts[d][raw[at - d : at]][raw[at]] += 1

    def node(symbols, bits):
        low = 0
        for b in bits:
            low = 2 * low + b
        width = 1 << (7 - len(bits))
        start = low << (8 - len(bits))
        return symbols[start : start + width].sum(), symbols[start + width : start + 2 * width].sum()

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(d, context, bits):
        a, b = node(counts[d][context], bits)
        own = log_kt(a, b)
        if d == depth:
            return own, 1.0
        below = sum(weighted(d + 1, c, bits)[0] for c in list(counts[d + 1]) if c[1:] == context or (d == 0 and len(c) == 1))
        both = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
        return both, math.exp(math.log(0.5) + own - both)

    def one(context, bits):
        total, weight = 0.0, 1.0
        for d in range(depth + 1):
            own = context[len(context) - d :]
            a, b = node(counts[d][own], bits)
            here = (b + 0.5) / (a + b + 1)
            _, stay = weighted(d, own, bits)
            last = d == depth or (context[len(context) - d - 1 :] not in counts[d + 1])
            if last:
                rest = 0.5  # no count is left for contexts that were not seen
                return total + weight * ((stay * here + (1 - stay) * rest) if d < depth else here)
            total += weight * stay * here
            weight *= 1 - stay

    def bits_of(text):
        raw = bytes([lm_scoring.START] * depth) + (text or "").encode().lower() + bytes([lm_scoring.END])
        out = 0.0
        for at in range(depth, len(raw)):
            bits = []
            for k in range(7, -1, -1):
                up = (raw[at] >> k) & 1
                p = one(raw[at - depth : at], tuple(bits))
                out -= math.log2(p if up else 1 - p)
                bits.append(up)
        return out

    return bits_of


def test_context_tree_equals_a_plain_recursion(spark):
    train = ["abab abba", "abra", "Baab\n"]
    rows = list(enumerate(train)) + [(10, "abc"), (11, ""), (12, None), (13, "ABBA zé")]
    df = frame(spark, rows).withColumn("trained", F.col("doc_id") < 10)
    found = by_id(lm_scoring.scored(df, trained_col="trained", depth=2))
    plain = plain_tree(train, 2)
    for i, t in rows:
        assert found[i]["bits"] == pytest.approx(plain(t), rel=1e-4), t
        assert found[i]["score"] == pytest.approx(-found[i]["bits"] * math.log10(2), rel=1e-12)


@pytest.mark.parametrize("least, split, share", [(1 << 12, 10, 20), (1, 30, 0), (2, 30, 40), (6, 30, 12)])
def test_rare_contexts_count_whatever_the_corpus(spark, least, split, share, monkeypatch):
    """Every context of the training texts has its weight, also one in 140,000 bytes, wherever the tree is cut."""
    for name, value in (("LEAST_GRAMS", least), ("SPLIT", split), ("GRAM_SHARE", share)):
        monkeypatch.setattr(lm_scoring, name, value, raising=False)
    train = ["abab abba", "abra", "Baab\n", "a" * 140_000]
    rows = list(enumerate(train)) + [(10, "abc"), (11, ""), (12, None), (13, "ABBA zé aaa"), (14, "xyxyxyxy")]
    df = frame(spark, rows).withColumn("trained", F.col("doc_id") < 10)
    found = by_id(lm_scoring.scored(df, trained_col="trained", depth=2))
    plain = plain_tree(train, 2)
    for i, t in rows:
        if i != 3:
            assert found[i]["bits"] == pytest.approx(plain(t), rel=1e-6), t


def test_byte_model_is_a_distribution(docs):
    counts = docs.select("text").mapInArrow(lm_scoring._counter(3), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    model = lm_scoring.byte_model(counts.where("kind = 0").select("key", "n"), 3)
    for table in model.log2:
        assert np.allclose(np.exp2(table.astype(np.float64)).sum(axis=1), 1.0, atol=1e-4)


def test_longer_contexts_help_on_held_out_text(docs):
    df = docs.withColumn("trained", crc_mod("doc_id", 5) != 1)
    bits = {}
    for depth in (0, 3):
        r = lm_scoring.scored(df, trained_col="trained", depth=depth).join(docs, "doc_id").where(crc_mod("doc_id", 5) == 1)
        bits[depth] = r.agg(F.sum("bits") / F.sum(F.octet_length("text"))).first()[0]
    assert bits[3] < 0.8 * bits[0] < 0.8 * 8


def test_scores_odd_rows(spark):
    found = lm_scoring.scored(odd(spark).withColumn("trained", F.lit(True)), trained_col="trained").collect()
    # Every row is scored by itself, also those that repeat an id or have none.
    want = sorted((repr(i), len(words(t)) + 1) for i, t in ODD_ROWS)
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in found) == want
    assert all(r["n_known"] == r["n_tokens"] for r in found)
    five = [r["score"] for r in found if r["doc_id"] == 5]
    assert len(five) == 2 and five[0] == pytest.approx(five[1])
    assert lm_scoring.scored(nothing(spark)).count() == 0
    untaught = lm_scoring.scored(odd(spark).withColumn("trained", F.lit(None).cast("boolean")), trained_col="trained").collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-6 for r in untaught)


# ---- 5 sharding ------------------------------------------------------------------------------


def test_shards_deal_texts_once(spark, docs):
    """Only pass one shuffles whole records, also where nothing is broadcast by its measured size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = sharding.shuffled_shards(docs, bucket_bytes=50_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1


def test_shards_are_even_gapless_and_whole(spark, docs):
    found = sharding.shuffled_shards(docs, bucket_bytes=50_000).collect()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, found)) == sorted(map(key, docs.collect()))
    order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3


def test_shards_do_not_depend_on_how_the_table_is_dealt(docs):
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(df).collect()}
    assert place(docs) == place(docs.repartition(7, "n_chars"))
    assert place(docs) != {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs, seed=1).collect()}


def test_equal_rows_spread_over_buckets(spark):
    """One record a hundred thousand times, besides others: no bucket holds much more than its part."""
    df = spark.range(0, 100_000, 1, 8).selectExpr("cast(null as long) doc_id", "'' as text").unionByName(
        spark.range(40_000).selectExpr("id as doc_id", "'' as text"))
    assert len(sharding._repeats(df.selectExpr("xxhash64(doc_id) as drawn"), 8)) == 1
    found = sharding.shuffled_shards(df, shards=4)
    counts = {r["shard"]: (r["count"], r["slots"]) for r in found.groupBy("shard").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("slot").alias("slots")).collect()}
    assert counts == {s: (35_000, 35_000) for s in range(4)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        largest = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest <= 4 * 140_000 / 8  # a few buckets may share a task; undealt it holds 100,000 rows


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, [k])) for k in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1150 and min(seen.values()) > 850


def test_shards_odd_rows(spark, tmp_path):
    found = sharding.shuffled_shards(odd(spark))
    assert found.count() == len(ODD_ROWS) and sorted(found.columns) == sorted(odd(spark).columns)
    assert sharding.shuffled_shards(nothing(spark)).count() == 0
    sharding.write_shards(found, str(tmp_path / "shards"), rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD_ROWS)


# ---- 6 decontamination -----------------------------------------------------------------------


def plain_hits(text, items, size=13):
    norm = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w = norm(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = norm(item_text)
        n = min(size, len(own))
        patterns = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in patterns:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontamination.AUTOMATON_BYTES, 4000])
def test_decontamination_equals_a_plain_scan(spark, texts, block_bytes):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()] + [(900, "Short, item"), (901, "word"), (902, None), (None, "x"), (903, "!!")]
    first = items[0][1]
    rows = list(texts.items()) + [
        (7000, "PREFIX-- " + first.upper().replace("É", "é") + " tail"), (7001, "a short item. Word! wörd word"), (7002, first + " " + first), (7003, None),
    ]
    b = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    found = by_id(decontamination.benchmark_hits(frame(spark, rows), b, block_bytes=block_bytes))
    for i, t in rows:
        r = found[i]
        n = sum(h["words"] for h in r["hits"])
        # Items without an id mark words but are not named.
        n_words, n_hit, named = plain_hits(t, items)
        assert (r["n_words"], n, r["items"]) == (n_words, n_hit, [x for x in named if x != "None"]), i
        for h in r["hits"]:
            assert decontamination.words_of(t)[h["word"] : h["word"] + h["words"]] == decontamination.words_of(t[h["start"] : h["end"]])


def test_blocks_judge_rows_of_one_id_one_by_one(spark):
    bench = spark.createDataFrame([(k, f"word{k} other") for k in range(8)], "item_id long, text string")
    rows = [(1, "word1 other x"), (1, "clean"), (None, "a word2 other"), (None, None), (None, "clean text here"), (3, "word3 other")]
    one, many = (
        sorted(map(str, decontamination.benchmark_hits(frame(spark, rows), bench, block_bytes=b).collect())) for b in (1 << 20, 20)
    )
    assert len(one) == len(rows) and one == many


def test_automaton_finds_every_window_wherever_it_is_cut():
    rng = random.Random(8)
    for _ in range(60):
        words = lambda n: [rng.choice("abc") + str(rng.randrange(3)) for _ in range(n)]
        items = [(str(k), " ".join(words(rng.choice([1, 3, 12, 13, 14, 20, 45])))) for k in range(6)]
        text = []
        for _ in range(8):
            own = rng.choice(items)[1].split()
            at = rng.randrange(len(own))
            text += words(rng.randrange(4)) + own[at : at + rng.randrange(1, 30)]
        n, ranges, found = decontamination.Automaton(items).scan(" ".join(text))
        assert (n, sum(b - a for a, b in ranges), sorted(found)) == plain_hits(" ".join(text), items)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word"), (2, None)], "item_id long, text string")
    found = decontamination.benchmark_hits(odd(spark), bench).collect()
    assert len(found) == len(ODD_ROWS) and {r["doc_id"] for r in found if r["items"]} == {4, 5, 9}
    assert decontamination.benchmark_hits(nothing(spark), bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] for r in decontamination.benchmark_hits(odd(spark), empty).collect())


# ---- 7 toxicity ------------------------------------------------------------------------------


def test_terms_in_any_script_match_themselves():
    terms = ["愚蠢的东西", "ばかやろう", "바보같은놈", "дурак", "idiot"]
    automaton = toxicity.LexiconAutomaton(terms)
    codes = np.array([ord(c) for t in terms for c in t], dtype=np.uint32)
    sizes = np.array([len(t) for t in terms])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    assert automaton.distances(codes, starts, sizes).tolist() == [0] * len(terms)
    codes[2] = ord("国")
    assert automaton.distances(codes, starts, sizes)[0] == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    rng = np.random.default_rng(3)
    letters = list("abcé")
    terms = sorted({"".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(40)})
    tried = ["".join(rng.choice(letters, rng.integers(1, 13))) for _ in range(1500)] + terms + [t[:-1] + "z" for t in terms]
    automaton = toxicity.LexiconAutomaton(terms)
    codes = np.frombuffer(" ".join(tried).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in tried])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    found = automaton.distances(codes, starts, lengths)
    for word, got in zip(tried, found):
        assert got == min((d for t in terms if (d := distance(word, t)) <= toxicity.edits_allowed(len(t))), default=9), word


def toxic_rows():
    rng = np.random.default_rng(1)
    filler = [f"wort{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(filler, 30))
        bad = i % 5 == 0
        if bad:
            w[int(rng.integers(2, 28))] = ["scoundrel", "villain", "rotter"][i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_finds_terms_misspellings_and_spares_quotation(spark):
    rows, labels = toxic_rows()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.terms == ["rotter", "scoundrel", "villain"]
    probe = [(1, "you scoundrel there"), (2, "wort1 wort2"), (3, "you SCOUNDRAL there"), (4, 'he wrote "scoundrel" there'), (5, None), (6, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, probe), model).collect()}
    assert got[1] > 0.5 > got[2] and got[1] > got[3] > got[2] and got[1] > got[4] >= got[2] and got[5] == got[6] == got[2]


def test_toxicity_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.toxicity(docs, model).join(labels.where(held), "doc_id").collect()
    bad, good = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([[(a > b) + 0.5 * (a == b) for a in bad] for b in good]) > 0.7
    assert sum(s >= 0.5 for s in good) <= 0.05 * len(good)


def test_toxicity_odd_rows(spark):
    model = toxicity.fit(odd(spark), spark.createDataFrame([(4, 1), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int"))
    assert toxicity.toxicity(odd(spark), model).count() == len(ODD_ROWS)
    empty = toxicity.fit(nothing(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.terms == [] and toxicity.toxicity(nothing(spark), empty).count() == 0
    assert {round(r["score"], 6) for r in toxicity.toxicity(odd(spark), empty).collect()} == {round(1 / (1 + math.exp(2.5)), 6)}


# ---- 8 packing -------------------------------------------------------------------------------


def check_packing(rows, found, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = collections.Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            expected[(i, piece, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    placed = collections.defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, texts, capacity):
    rows = list(texts.items()) + ODD_ROWS + [
        (9000, "The <|endoftext|> tag<|startoftext|>x"), (9001, "a.b, c.d. e... 'S it's é İ ﬁ \x1c \x85 　 x"), (9002, "Ü." * 50 + " ok.,"),
    ]
    found = packing.packed_pieces(frame(spark, rows), TOKENIZER, capacity=capacity).collect()
    sequences = check_packing(rows, found, capacity)
    total = sum(r["length"] for r in found)
    assert sequences <= 1.1 * math.ceil(total / capacity) + 1


def test_sequences_hold_the_ids(spark, texts):
    packed = packing.packed_pieces(frame(spark, list(texts.items())[:30]), TOKENIZER, with_ids=True)
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert own == bytes(r["ids"]) and zlib.crc32(own) == r["ids_crc32"]


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    histogram = collections.Counter(rng.integers(1, capacity + 1, rng.integers(1, 400)).tolist())
    plan = packing.best_fit_plan(histogram, capacity)
    used, placed = collections.Counter(), collections.Counter()
    spans = collections.defaultdict(list)
    for length, rank, items, first, each, offset in plan.tolist():
        for k in range(items):
            spans[first + k // each].append((offset + k % each * length, length))
            placed[(length, rank + k)] += 1
            used[first + k // each] += length
    assert placed == collections.Counter((x, r) for x, c in histogram.items() for r in range(c))
    assert max(used.values()) <= capacity
    for own in spans.values():
        assert [o for o, _ in sorted(own)] == np.concatenate([[0], np.cumsum([x for _, x in sorted(own)])])[:-1].tolist()
    rooms = []  # one document at a time
    for length in sorted(histogram.elements(), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    assert len(used) == len(rooms)


def test_packing_without_rows(spark):
    assert packing.packed_pieces(nothing(spark), TOKENIZER).count() == 0


# ---- 9 substring dedup -----------------------------------------------------------------------


def test_repeats_equal_a_plain_scan(spark, texts):
    shared = " ".join(f"s{k}" for k in range(57))
    rows = dict(texts)
    rows |= {8000 + k: f"{'pre ' * (k % 13)}{shared if k % 3 else ' '.join(shared.split()[k % 20:])} post{k}" for k in range(60)}
    rows |= {8500: "again and " * 200, 8501: "again and " * 15, 8502: shared + " " + shared, 8503: " ".join(shared.split()[:20]), 8504: " ".join(shared.split()[:19])}
    rows |= {9001: None, 9002: "", 9003: LONG}
    found = by_id(substring_dedup.repeated_passages(frame(spark, list(rows.items())).repartition(5)))
    for i, expected in repeats_removed(rows).items():
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) == expected, i
        assert sum(r["words"] for r in found[i]["ranges"]) == expected[1]
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.kept_texts(
        frame(spark, list(rows.items())), substring_dedup.repeated_passages(frame(spark, list(rows.items())))).collect()}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == e[2] for i, e in repeats_removed(rows).items())


def test_small_pieces_give_the_same_repeats(spark, texts, monkeypatch):
    for name, value in (("FLUSH_WORDS", 500),):
        monkeypatch.setattr(substring_dedup, name, value)
    pieces = substring_dedup._Pieces()
    assert pieces.size == 0
    found = by_id(substring_dedup.repeated_passages(frame(spark, list(texts.items()))))
    assert {i: r["n_removed"] for i, r in found.items()} == {i: e[1] for i, e in repeats_removed(texts).items()}


def test_places_survive_coding():
    ids = np.array([5, 5, 5, -2, -2, 9, 5, 5], dtype=np.int64)
    at = np.array([0, 300, 301, 254, 70_000, 3, 2, 600], dtype=np.int64)
    back = substring_dedup._decoded(*substring_dedup._coded(ids, at))
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == at.tolist()


def test_repeats_odd_rows(spark):
    found = substring_dedup.repeated_passages(odd(spark)).collect()
    assert len(found) == len(ODD_ROWS)
    ids = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert ids[12]["n_removed"] == 119 and ids[13]["n_removed"] == 120 and ids[1]["n_words"] == 0 and ids[5]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in found if r["doc_id"] is None)
    assert substring_dedup.repeated_passages(nothing(spark)).count() == 0


# ---- 10 near duplicates ----------------------------------------------------------------------


@pytest.mark.parametrize("threshold,block", [(0.85, 512), (0.8, 4)])
def test_near_duplicates_equal_all_pairs(spark, texts, threshold, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = {i: t for i, t in texts.items()} | {20_000 + i: t for i, t in near_copies().items()}
    rows |= {30_000: "one two", 30_001: "ONE two", 30_002: "one two three four five", 30_003: None, 30_004: " "}
    found = by_id(near_dedup.near_duplicates(frame(spark, list(rows.items())), threshold=threshold))
    expected = linked_components(rows, round(100 * threshold))
    for i in rows:
        assert (found[i]["component_id"], found[i]["n_shingles"]) == (expected[i], len(shingle_set(rows[i]))), i
        assert found[i]["kept"] == (expected[i] == i)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1700], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    sig = near_dedup.signatures(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, 2000, 4000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1700 / 2300) < 0.08


def test_pi_is_a_bijection():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(near_dedup._pi(x.copy()))) == len(x)


def test_near_duplicates_odd_rows(spark):
    found = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(found) == len(ODD_ROWS)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
    ids = {r["doc_id"]: r for r in found}
    assert ids[9]["component_id"] == 4 and ids[13]["component_id"] == 12 and not ids[13]["kept"] and ids[1]["n_shingles"] == 0
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (None, 5), (300, 200), (200, 300)]
    found = {r["doc_id"]: r["component_id"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_without_and_thinned(spark):
    rows = frame(spark, [(k, f"t{k}") for k in range(500)] + [(None, "n"), (3, "again")])
    gone = spark.createDataFrame([(k,) for k in range(0, 500, 3)] + [(None,)], "doc_id long")
    left = idfilter.without(rows, gone)
    assert left.columns == rows.columns
    assert sorted(r["text"] for r in left.collect()) == sorted([f"t{k}" for k in range(500) if k % 3] + ["n"])
    assert idfilter.without(rows, gone, bits=64).count() == left.count()
    assert {r["doc_id"] for r in idfilter.thinned(rows, gone).collect()} >= set(range(0, 500, 3))
