"""The pipeline's rows against the operators' definitions, computed by hand."""

import base64

import public_tokenizers
import tiktoken
from test_anchor_simhash import least_by_hand, print_by_hand
from test_host_quality import by_hand

import corpus_pipeline
from rolodeck.llm import pfair_mix
from rolodeck.llm.staging import Staged


def test_rows_equal_the_stages_by_hand(spark, tmp_path):
    texts = [" ".join(f"w{i * 31 + k}" for k in range(40)) for i in range(30)]
    texts += [texts[3], texts[3].upper(), texts[5], None, "", "too short", "again and again and again " * 20, "it's a doc that's all its own, isn't it? " + " ".join(map(str, range(30)))]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    good = []
    for r in rows:
        n, *_, repeated = by_hand(r[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            good.append(r)
    least = least_by_hand([print_by_hand(r[1]) for r in good], [r[0] for r in good])
    kept = [r for r, first in zip(good, least) if r[0] == first]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {r[0]: library.encode_ordinary(r[1]) for r in kept} and len(got) == len(kept) < len(good)


def test_position_is_the_place_in_the_mixture(spark, tmp_path):
    # texts grow with the place in their source, so the files of the mixture are not read in their order
    texts = [" ".join(f"w{i * 3001 + k}" for k in range(20 + 2 * (i % 400))) for i in range(1200)]
    rows = [(i, t, "en", f"src{i // 400}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates):
        docs = Staged(stage(spark, docs, str(tmp_path)), "before-mixture").df
    want = {r["doc_id"]: r["position"] for r in pfair_mix.mixed(docs).collect()}
    mixture = Staged(corpus_pipeline.mixture(spark, docs, str(tmp_path)), "mixture").df
    assert len(mixture.inputFiles()) > 1 and [r["doc_id"] for r in mixture.collect()] != sorted(want, key=want.get)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["position"] for r in got} == want and sorted(want.values()) == list(range(len(got)))
