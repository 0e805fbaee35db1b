import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from pitchframe.llm import token_planes as tp
from pitchframe.llm.files import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("ids", [[0], [1, 2, 3], [65535, 65536, 2**32 - 1], list(range(1000))])
def test_planes_round_trip(kind, ids):
    ids = np.array(ids, dtype=np.uint32)
    planes = tp.pack_planes(ids, kind, zstandard.ZstdCompressor())
    assert (tp.unpack_planes(planes, len(ids), kind, zstandard.ZstdDecompressor()) == ids).all()


def odd_texts():
    rnd = random.Random(3)
    bits = ["a", "the", "it's", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "<|endoftext|>", "12", "!!", "\r\n", "\x1c", " ", "🙂", "'ll"]
    return ["", " ", "  ", " a", "a ", "a  ", "x   y", "\n a"] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(3000)]


def test_cut_texts_encode_as_whole_texts():
    import pyarrow as pa

    texts = odd_texts()
    plain = Tokenizer.from_file(PATH)
    got = tp.Encoder(PATH).encode(pa.array(texts))
    for text, ids in zip(texts, got):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def brute(rows):
    plain, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_against_brute_force(spark, rows, planes):
    texts = [(i, t) for i, t in enumerate(odd_texts()[:300])] + [(1000, None), (2000, "word " * 50_000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id bigint, text string, ids string").repartition(5)
    manifest = tp.write_tokens(df, new_folder(spark, "t"), PATH, planes=planes, file_ids=20_000)
    assert manifest.count() > 1
    assert rows(tp.read_digests(manifest)) == brute(texts)
    got = {r.doc_id: (r.start, r.ids) for r in tp.read_ids(manifest).collect()}
    plain = Tokenizer.from_file(PATH)
    assert all(got[k][1] == plain.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts)


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    got = tp.read_digests(tp.write_tokens(df, new_folder(spark, "t"), PATH)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1]
    assert sorted(r.n_tokens for r in got[:2]) == [1, 2] and got[2].ids_crc32 == got[3].ids_crc32
    assert tp.read_digests(tp.write_tokens(df.limit(0), new_folder(spark, "t"), PATH)).count() == 0
