"""Words that polynomials modulo a power of two can't tell apart."""

import base64
import gc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tilewright.llm import bpe, jaccard_join, substring_dedup, textkit
from tilewright.llm.textkit import word_hashes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (1024, 2048, 4096, 8192)]


def test_hashes_differ_and_do_not_depend_on_the_place():
    words = [w for pair in PAIRS for w in pair] + ["a", "aa", "\0", "\0\0", "the"]
    blob = np.frombuffer(" ".join(words + words[::-1]).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words + words[::-1]]) - 1
    starts = np.append(0, ends[:-1] + 1)
    hashes = word_hashes(blob, starts, ends)
    assert len(set(hashes[: len(words)].tolist())) == len(words)
    assert (hashes[: len(words)] == hashes[len(words) :][::-1]).all()


def test_bpe_of_such_words(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [w for pair in PAIRS for w in pair]
    vocabulary = bpe.load(spark, RANKS)
    rows = bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), vocabulary), vocabulary).collect()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_bpe_where_hashes_meet(spark, monkeypatch):
    vocabulary = bpe.Vocabulary(RANKS)
    texts = ["alpha beta qqqq", "gamma beta zzzzq", "", "alpha delta"]
    want = [vocabulary_ids(vocabulary, t) for t in texts]
    import pyarrow as pa

    monkeypatch.setattr(bpe, "word_hashes", lambda text, starts, ends: (ends - starts).astype(np.uint64))
    ids, counts = bpe.Encoder(vocabulary).encode(pa.array(texts))
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == want


def vocabulary_ids(vocabulary, text):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    return library.encode_ordinary(text)


@pytest.mark.parametrize("pair", PAIRS[:2])
def test_sets_and_windows_of_such_words(spark, pair):
    rows = [(i, f"one two {w} four five") for i, w in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs).collect()}
    assert got == {0: 0, 1: 1}
    filler = [f"w{i}" for i in range(19)]
    docs = spark.createDataFrame([(i, " ".join([*filler, w])) for i, w in enumerate(pair)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup_substrings(docs).collect()] == [0, 0]


def test_power_tables_take_no_more_than_asked():
    powers = textkit._geometric(3, 2147483629, 700)
    assert (powers.base is None or powers.base.nbytes == powers.nbytes) and powers.tolist() == [pow(3, k, 2147483629) for k in range(700)]


def test_workers_drop_the_vocabulary_with_the_job(spark):
    def held(batches):
        for batch in batches:
            n = sum(type(x).__name__ == "Vocabulary" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int32())], ["n"])

    docs = spark.createDataFrame([(i, f"unheardofword{i} and some more") for i in range(40)], "id long, text string").repartition(4)
    assert bpe.encode(docs, bpe.load(spark, RANKS)).filter("size(ids) > 4").count() == 40
    assert {r["n"] for r in docs.select("id").mapInArrow(held, "n int").collect()} == {0}
