import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_equals_the_library():
    rng = random.Random(5)
    own, theirs = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    marks = ["a", "aa", "aaaaaaaa", "Hello", "WORLD'S", "don't", "'LL", " ", "\n", "\t", "\x0b", "é", "É", "x́", "́", "12", "!!", "...", "<|endoftext|>", "<|startoftext|>", "<|END", "　", "\xa0", " ", "\x1c", "\x85", "​", "日本語", "ΣΑΣ", "İ", "ß", "\U0001f600", "ﬁ", "가", "가", "½", "٣"]
    texts = ["", None, "   ", *("".join(rng.choices(marks, k=rng.randint(1, 20))) for _ in range(2500))]
    for t, (n, ids, decoded) in zip(texts, own.encode(texts)):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(t)
        assert decoded == theirs.decode(want, skip_special_tokens=False)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    theirs = Tokenizer.from_file(PATH)
    for r in docs.select("text", bpe.encoded(F.col("text"), PATH).alias("r"), bpe.digested(F.col("text"), PATH).alias("d")).collect():
        want = theirs.encode(r.text, add_special_tokens=False).ids
        assert r.r.ids == " ".join(map(str, want)) and r.r.decoded == theirs.decode(want, skip_special_tokens=False)
        assert r.d.ids_sha256 == hashlib.sha256(r.r.ids.encode()).hexdigest() and r.d.decoded_sha256 == hashlib.sha256(r.r.decoded.encode()).hexdigest()


def test_store_may_be_dropped(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    own = bpe.WordBPE(PATH)
    first = own.encode(["some words here now", "and others too"])
    own.encode(["x y z w"])
    assert own.encode(["some words here now", "and others too"]) == first


def test_odd_rows(odd, none):
    got = odd.select("doc_id", bpe.encoded(F.col("text"), PATH).alias("r")).select("doc_id", "r.*").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 0 and by[5].decoded == ""
    assert none.select(bpe.encoded(F.col("text"), PATH)).count() == 0
