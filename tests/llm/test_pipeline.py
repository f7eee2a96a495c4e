import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from cuesheet.llm import bpe, quality, toxicity

from .test_decontaminate import brute as leaks
from .test_neardup import brute as groups


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, toxicity.train(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] < toxicity.THRESHOLD]
    clean = []
    for i, t in rows:
        n, chars, _, _, rep, gone, _, text = quality.judge_text(t or "")
        if n >= 50 and 100 * rep <= 50 * n and 2 * gone <= chars:
            clean.append((i, text))
    one = sorted(min(clean[k] for k in g) for g in groups(clean))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {i for i, _, hit, _ in leaks(one, items) if hit}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: ref.encode_ordinary(t) for i, t in one if i not in dirty}
    got = C.run(spark, sf).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == want and all(r["round_trip"] for r in got)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(40), sf).columns == docs.columns, name
