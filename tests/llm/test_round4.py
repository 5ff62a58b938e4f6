import gc

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_operators import key_corpus

from shiftlens.llm import bpe, secrets, tokens


def test_secret_network_learns_from_all_documents(spark):
    """A first sample of next to nothing leaves the network, its calibration and its threshold to the whole table, however it is dealt."""
    corpus = key_corpus(spark)
    nets = [secrets.fit(corpus.repartition(n), sample=40, most=8) for n in (1, 5)]
    for name in ("kernel", "bias", "dense", "calibration", "threshold"):
        assert np.array_equal(getattr(nets[0], name), getattr(nets[1], name)), name
    found = {r.doc_id: r.spans for r in secrets.find_secrets(corpus.where("doc_id < 9000"), nets[0]).collect()}
    assert sum("model" in found[3000 + i] for i in range(60)) >= 54
    assert sum("model" in found[5000 + i] for i in range(400)) <= 8
    texts = [r.text for r in corpus.select("text").distinct().collect()]
    codes = sorted({c for t in texts for base in secrets.base_spans(t) for c in secrets.masked(t, *base)})
    part = {bytes(r.codes): r.p for r in spark.createDataFrame([(c,) for c in codes], "codes binary").select("codes", F.pmod(F.xxhash64("codes"), F.lit(6)).alias("p")).collect()}
    kept = np.frombuffer(b"".join(c for c in codes if part[c] in (2, 5)), np.uint8).reshape(-1, secrets.WIDTH)
    # The highest step of 2**-18 of a logit: no more findings are lost than allowed, and one step more loses more.
    logits = np.sort(nets[0].logits(kept))
    assert (nets[0].probability(kept) >= nets[0].threshold).mean() >= 0.95
    next_edge = np.floor(logits[int(0.05 * len(logits))] * 2**18 + 1) / 2**18
    assert (logits < next_edge).sum() > int(0.05 * len(logits))


def test_secret_refinement_changes_what_the_sample_lacks(spark):
    """A window on the wrong side of the margin in any document moves the weights; none does where all are right."""
    base = secrets._random()
    own = secrets._Refined(base, 0)
    own.found = [bytes(np.full(secrets.WIDTH, 3, np.uint8))]
    own.add("government mountains wonderful yesterday")
    weights = np.array(own.row().column("weights")[0].as_py()) / 2.0**32
    assert own.adam.step == 1 and abs(weights - np.concatenate([p.ravel() for p in base])).max() > 1e-4
    sure = [np.zeros_like(base[0]), np.zeros_like(base[1]), np.append(np.zeros(24), -5.0)]
    own = secrets._Refined(sure, 0)
    own.add("government mountains wonderful yesterday")
    own.row()
    assert own.adam.step == 0


def test_words_by_the_model_alone(tmp_path):
    """The model is asked directly only where the tokenizer does no more than spell bytes, and then gives the same ids."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    path = P.path("byte_bpe_50k.json")
    cache, coder = tokens.PieceCache(path, P.PATTERN), Tokenizer.from_file(path)
    words = [" government", "x", " \u00e9t\u00e9", " \u043c\u0438\u0440", "\n\n", "\x00\x7f\x80\xa0\xad\xff", " 12345", "\U0001f600\U0001f601", " ...!?", " " * 7, "'s", "\u4e2d\u6587" * 40]
    assert cache.spells and cache.words(words) == [coder.encode(w, add_special_tokens=False).ids for w in words]
    for change in (lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.Whitespace()), lambda t: t.enable_truncation(3)):
        other = Tokenizer.from_file(path)
        change(other)
        other.save(own := str(tmp_path / "own.json"))
        texts = ["Government Mountains and WONDERFUL letters", "", "One"]
        plain = tokens.PieceCache(own, P.PATTERN)
        assert not plain.spells
        assert plain.words(texts) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert cache.encode(["government"])[0].tolist() == coder.encode("government", add_special_tokens=False).ids and gc.isenabled()


def test_encoder_sizes_change_no_result(spark):
    """Neither chunks nor the dictionary's size change a row."""
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    rows = [(i, f"government mountains {i} wonderful letters {i % 7}\u00e9 {chr(0x430 + i % 30) * 5}" * (1 + i % 3)) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(bpe.encode_documents(docs, ranks, P.PATTERN).collect())
    assert len(one) == 202 and one == sorted(bpe.encode_documents(docs, ranks, P.PATTERN, chunk=1000, dictionary=3).collect())
