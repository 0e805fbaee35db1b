import base64
import gzip
import hashlib

import pytest

from pitchframe.llm import warc
from pitchframe.llm.files import new_folder, open_fs


def brute(pages, least=0):
    """Hand rule over (page, html): the largest page of a payload answers, others point to it."""
    out = []
    for page, html in pages:
        data = (html or "").encode()
        same = [p for p, h in pages if (h or "").encode() == data and p is not None]
        holder = max(same) if len(data) >= least and same else page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = page is not None and page != holder
        out.append((page, len(data), digest, "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


PAGES = [(1, "<p>é</p>"), (2, None), (3, ""), (4, "<p>é</p>"), (9, "x" * 300_000), (5, "x" * 300_000), (7, "a\r\n\r\nb"), (7, "c"), (7, "c"), (-8, "\r\n"), (2**60, "c"), (None, "c"), (None, "only")]


@pytest.mark.parametrize("least", [0, 2, 1000])
@pytest.mark.parametrize("sizes", [(1 << 28, 1 << 26), (2000, 1 << 26), (1 << 28, 500)])
def test_round_trip(spark, least, sizes):
    rows = [(p, "http://x/\n" if p == 1 else None, h, "extra") for p, h in PAGES]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    manifest = warc.write_warc(df, new_folder(spark, "w"), least=least, shard_bytes=sizes[0], file_bytes=sizes[1])
    back = warc.read_warc(manifest).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=str)
    assert got == brute(PAGES, least)
    assert all(r.payload is None or len(r.payload) == r.payload_bytes for r in back)
    for path in {r.file for r in back}:
        ids = [(r.page_id is not None, r.page_id or 0) for r in sorted((x for x in back if x.file == path), key=lambda x: x.place)]
        assert ids == sorted(ids)


def test_files_do_not_depend_on_partitions(spark):
    def files(parts):
        df = spark.createDataFrame([(p, None, h) for p, h in PAGES if p is not None], "page_id bigint, url string, html string").repartition(parts)
        folder = new_folder(spark, "w")
        manifest = warc.write_warc(df, folder, shard_bytes=1500, file_bytes=400)
        out = {}
        for r in manifest.collect():
            fs, path = open_fs(r.path)
            out[r.name] = fs.open_input_stream(path, compression=None).read()
        left = [f for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(open_fs(folder)[1])) if f.base_name.startswith("_")]
        assert not left
        return out

    a, b = files(2), files(7)
    assert a == b and len(a) > 2
    assert all(gzip.decompress(v).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for v in a.values())


def test_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_warc(warc.write_warc(df, new_folder(spark, "w"))).count() == 0
