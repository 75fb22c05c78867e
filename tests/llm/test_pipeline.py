import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from millrace.llm.personal_data import Finder, redact
from millrace.llm.toxicity import train_toxicity
from tests.llm.cases import AWKWARD, frame
from tests.llm.test_decontamination import brute as contaminated_rows
from tests.llm.test_ngram_join import brute as component_rows
from tests.llm.test_ngram_join import near_copies, shingles


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    items = [(i, words(20)) for i in range(3)]
    docs = near_copies(1, 3, 6, 40, 2) + [(300 + i, f"{words(50)} call +1 (456) 555-2186 {words(5)}", "en", "s", 9) for i in range(4)]
    docs += [(400, f"{words(20)} {items[1][1]}", "en", "s", 9), (401, f"idiot moron {words(8)} scum", "en", "s", 9)]
    docs += [(500 + (r[0] or 0), *r[1:]) for r in AWKWARD]
    labels = [(d[0], 1, int(d[0] == 401)) for d in docs]
    folder = f"{tmp_path}/t"
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    model = train_toxicity(frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int"))
    left = [d for d in docs if model.score(d[1] or "") < 0.5]
    assert len(left) == len(docs) - 1
    named = {(i, n): c for i, n, c in component_rows(left)}
    seen, kept = set(), []
    for d in left:
        n = len(shingles(d[1]))
        if n == 0 or (named[d[0], n] == d[0] and d[0] not in seen):
            kept.append(d)
            seen |= {d[0]} if n else set()
    dirty = {r[0] for r in contaminated_rows([(d[0], d[1]) for d in kept], items) if r[4]}
    clean = [d for d in kept if d[0] not in dirty]
    assert dirty == {400}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    finder = Finder()
    want = sorted((d[0], library.encode(redact(d[1] or "", finder.spans(d[1] or "")))) for d in clean)

    found = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.token_ids) for r in found.collect()) == want
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    redacted = {r.doc_id: r for r in current.collect()}
    assert not re.search(r"\+1", redacted[300].text) and redacted[300].n_chars == len(redacted[300].text) and redacted[501].text is None


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        frame(spark, [], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    names = list(corpus_pipeline.QUERIES)
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 14)] == names[:13] and names[13] == "pipeline"
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
