"""Personal data, pieces, sharding and quality rules against brute force."""

import hashlib
import math
import random
import re
import sys
from fractions import Fraction

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.personal_data import BASE_KINDS, Finder, find_personal_data, iban_length, luhn, personal_data_digest, redact
from millrace.llm.pieces import ChunkCoder, encode_pieces, piece_digest
from millrace.llm.quality_rules import RATES, RuleSettings, apply_rules, binomial_tail_log, learn_cutoffs, measure_texts
from millrace.llm.sharding import fill_table, place_rows, write_shards
from tests.llm.cases import AWKWARD, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1290@.+-_ ()%é4", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in Finder().spans(text) if s[0] in BASE_KINDS] == base_spans(text)


def test_personal_data_kinds_and_redaction(spark):
    text = (
        "Write to bob@example.com or +1 (456) 555-2186, host 32.198.59.21, card 4111 1111 1111 1111; "
        "IBAN: DE89 3704 0044 0532 0130 00, Account no. 12345678, see https://bob:pw@host.org/x and mailto:amy@x.org."
    )
    spans = Finder().spans(text)
    assert [s for s in spans if s[0] in BASE_KINDS] == base_spans(text)
    assert {k for k, _, _ in spans} == {"email", "phone", "ip", "card", "account", "link"}
    assert not re.search(r"[0-9]|@", redact(text, spans))
    assert iban_length("DE89370400440532013001", 0) == 0
    docs = frame(spark, [*AWKWARD, (50, text, "en", "s", 1)]).withColumn("redacted", F.lit(1))
    found = {r.doc_id: r for r in find_personal_data(docs).collect()}
    assert found[50].redacted == redact(text, spans) and found[1].pii_spans == [] and found[5].redacted == AWKWARD[4][1]
    digest = {r.doc_id: r for r in personal_data_digest(docs).collect()}[50]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
    assert digest.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and digest.n_email == 3
    assert personal_data_digest(docs.limit(0)).count() == 0


def test_base_spans_of_long_digit_runs():
    for text in ("0" * 5_000 + "1.2.3.4", "9" * 5_000 + ".1.1.1", "1.2.3." + "0" * 9_999, "+" + "1" * 6_000, "7" * 20_000, "1." * 30_000):
        sys.set_int_max_str_digits(0)  # the patterns' own check reads numbers of any length
        want = base_spans(text)
        sys.set_int_max_str_digits(4_300)
        assert [s for s in Finder().spans(text) if s[0] in BASE_KINDS] == want
    assert Finder().spans("0" * 5_000 + "1.2.3.4") == [("ip", 0, 5_007)]


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb\tc ", "▁", "x ▁y", "▁▁", "é", "<s> <unk>", "\x00", "日本語 テキスト", "😀 😀"]
    texts += ["".join(rng.choice("ab  \n.éß▁😀\t0") for _ in range(rng.randrange(40))) for _ in range(400)]
    for size in (250_000, 20):
        coder = ChunkCoder(MODEL, size)
        for start in range(0, len(texts), 50):
            for text, (ids, decoded) in zip(texts[start:], coder.code(texts[start : start + 50]), strict=False):
                want = library.encode(text)
                assert ids == ",".join(map(str, want)) and decoded == library.decode(want), repr(text)
    rows = {r.doc_id: r for r in piece_digest(frame(spark, AWKWARD), MODEL).collect()}
    for doc_id, text, *_ in AWKWARD:
        ids = library.encode(text or "")
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    real = encode_pieces(frame(spark, AWKWARD).withColumn("decoded", F.lit(1)), MODEL)
    assert all(r.token_ids == library.encode(r.text or "") and r.decoded == library.decode(r.token_ids) for r in real.collect())


def naive_table(names, size):
    """The published filling algorithm, written with whole preference lists."""
    number = lambda salt, n: int.from_bytes(hashlib.sha256(f"{salt}:{n}".encode()).digest()[:8], "big")
    orders = [[(number("offset", n) % size + j * (number("step", n) % (size - 1) + 1)) % size for j in range(size)] for n in names]
    table, claimed = [None] * size, 0
    while claimed < size:
        for i, order in enumerate(orders):
            slot = next((s for s in order if table[s] is None), None)
            if slot is not None:
                table[slot], claimed = i, claimed + 1
    return table


def test_lookup_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    table = fill_table(names, 101)
    assert table == naive_table(names, 101)
    full, fewer = fill_table(names, 5003), fill_table(names[:-1], 5003)
    assert max(map(full.count, range(7))) - min(map(full.count, range(7))) <= 1
    assert sum(a != b for a, b in zip(full, fewer, strict=True)) < 0.3 * 5003  # a seventh must move
    double = fill_table(names, 5003, turns=[2, 1, 1, 1, 1, 1, 1])
    assert abs(double.count(0) - 2 * double.count(1)) <= 2
    for bad in (([], 101), (["a", "a"], 101), (names, 100)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_rows_are_placed_by_key(spark, tmp_path):
    names, table = [f"s{i}" for i in range(5)], fill_table([f"s{i}" for i in range(5)], 1009)
    docs = frame(spark, AWKWARD).withColumn("shard", F.lit("old"))
    placed = place_rows(docs, F.col("doc_id"), names, 1009, fallback=F.col("text"))
    assert placed.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    assert all(r.shard == table[r.slot] for r in placed.collect()) and placed.count() == len(AWKWARD)
    assert placed.filter("doc_id = 6").select("slot").distinct().count() == 1
    assert not re.search("Python|Pandas|Arrow", placed._jdf.queryExecution().executedPlan().toString())
    write_shards(place_rows(spark.range(500), F.col("id"), names, 1009), f"{tmp_path}/out", 30)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and len(back.inputFiles()) > 5
    assert place_rows(docs.limit(0), F.col("doc_id"), names, 1009).count() == 0


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    joined = "".join(words)
    return (len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "# ", "B\n", "\n", "é", "|\t"]) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(150)]
    rows += [r for r in AWKWARD if r[0] != 5]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = measure_texts(frame(spark, rows).withColumn("n_words", F.lit("old"))).select("text", *names)
    assert {(r[0], *r[1:]) for r in found.collect()} == {(r[1], *measures(r[1])) for r in rows}
    long = measure_texts(frame(spark, [AWKWARD[4]])).first()
    assert long.n_words == 80_000 and long.n_repeat_words == 80_000


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 20, 400) for k in (0, 1, 3, n)]
    found = spark.createDataFrame(cases, "n long, k long").withColumn("log", binomial_tail_log(F.col("n"), F.col("k"), 0.02)).collect()
    p = Fraction(1, 50)
    for r in found:
        exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.log - math.log(exact)) < 1e-9


def test_cutoffs_keep_the_risk_and_need_evidence(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 6 == 0
        text = " ".join((f"w{rng.randrange(10**6)}" + ("#" if bad or rng.random() < 0.001 else "")) for _ in range(60))
        rows.append((i, text, "en" if i % 3 else "rare" if i % 300 == 0 else None, "s", 1))
        labels.append((i, 0 if bad else 1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = apply_rules(frame(spark, [*rows, *AWKWARD]), marks, RuleSettings(risk=0.2))
    kept = {r.doc_id: r.kept for r in judged.collect()}
    good = [kept[i] for i, q in labels if q]
    assert sum(not k for k in good) <= 0.2 * len(good)
    assert not any(kept[i] for i, q in labels if not q and i % 3 == 0 and i % 300)
    assert all(kept[i] for i in range(0, 3000, 300))  # the rare stratum has too few labels for any cutoff
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().executedPlan().toString())
    none = apply_rules(frame(spark, AWKWARD), marks.limit(0))
    assert none.count() == len(AWKWARD) and none.filter("kept").count() == 0
    assert apply_rules(frame(spark, AWKWARD).limit(0), marks).count() == 0


def test_cutoffs_are_the_least_admissible(spark):
    settings_ = RuleSettings(cutoffs=(0.1, 0.5), folds=10**9)
    rows = [(i, "x", f"t{i}", i, 0.3 if i < 30 else 0.0) for i in range(3000)]
    frame_ = spark.createDataFrame(rows, "doc_id long, stratum string, t string, text_key long, v double").withColumn("stratum", F.lit("x"))
    frame_ = frame_.select("doc_id", "stratum", "text_key", *(F.col("v").alias(r) for r in RATES))
    marks = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    # 30 of 3000 lie above 0.1: one percent cannot be shown to be at most one percent, none above 0.5 can.
    assert {v for k, v in learn_cutoffs(frame_, marks, settings_).first().asDict().items() if k != "stratum"} == {0.5}
