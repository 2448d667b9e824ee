"""The pipeline's stages one by one on what the stage before kept, and run() as their chain."""

from collections import Counter

import corpus_pipeline as C
import pytest
from llm.test_decontaminate import brute as contaminated
from llm.test_tokenstore import brute as token_rows
from tokenizers import Tokenizer

from tidebook.llm import entries
from tidebook.llm.common import stored, table


def test_stages(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    kept = [docs]
    for name, stage in C.STAGES:
        kept.append(stored(stage(spark, kept[-1], small_dir), f"test-{names.index(name)}"))
        assert name == names[-1] or kept[-1].columns == docs.columns
    _, language, single, clean, mixed, tokens = ([tuple(r) for r in k.collect()] for k in kept)
    assert set(language) <= set(map(tuple, docs.collect())) and len(single) < len(language)
    items = [(r.item_id, r.text) for r in table(spark, small_dir, "benchmark").collect()]
    assert Counter(clean) == Counter(r for r in single if not contaminated([r[:2]], items, 10)[0][5])
    assert len(clean) < len(single) and set(mixed) <= set(clean)
    tokenizer = Tokenizer.from_file(entries.tokenizer_path())
    assert Counter((r[0], r[2], r[3]) for r in tokens) == token_rows([r[:2] for r in mixed], tokenizer)
    again = C.run(spark, small_dir)
    assert Counter(map(tuple, again.collect())) == Counter(tokens)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Bare

    from tidebook.llm.common import shared_dir

    context = Bare(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare(conf={}, sparkContext=context))
    assert shared_dir(Bare(conf={"spark.checkpoint.dir": "hdfs:/x/"}, sparkContext=context)) == "hdfs:/x"
