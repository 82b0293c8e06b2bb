from __future__ import annotations

import gzip
import hashlib
import random

import numpy as np
import pytest

from boxoffice.llm import warc
from boxoffice.llm.files import local_path
from boxoffice.llm.warc import local_exits, read_warc, warc_folder, write_warc

SCHEMA = "page_id long, url string, html string, payload_digest string"


def pages_rows() -> list[tuple]:
    rng = random.Random(1)
    inner = warc.record(77, "u", b"inside", "0" * 40, None).decode()
    long = "".join(rng.choice("abcdef <>") for _ in range(3000))
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abcdefghij \n") for _ in range(rng.randint(0, 5000)))) for i in range(60)]
    rows += [(100, "u\r\nv", inner * 3), (101, None, inner + "tail"), (102, "é", long), (103, "u", long), (104, "u", long), (104, "u", long), (None, "u", long)]
    rows += [(105, "u", "short"), (106, "u", "short"), (107, "u", None), (108, "u", ""), (109, "u", "ü" * 200_000), (None, None, None), (110, "u", "é" * 500), (111, "u", "é" * 500)]
    return [(*r, "x") for r in rows]


@pytest.mark.parametrize(("compress", "split"), [(True, 700), (True, 1 << 20), (False, 900), (False, 40_000)])
def test_round_trip(spark, compress, split):
    rows = pages_rows()
    manifest = write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), warc_folder(spark), compress=compress)
    got = read_warc(manifest, split).collect()
    most = {}
    for i, _, html, _ in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            most[html] = max(most.get(html, i), i)
    want = []
    for i, url, html, _ in rows:
        body = (html or "").encode()
        refers = most.get(html) if most.get(html) != i else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else body, url and url.replace("\r\n", " ")))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None, r.url) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, want))


def test_archive_is_standard(spark):
    manifest = write_warc(spark.createDataFrame(pages_rows(), SCHEMA).coalesce(1), warc_folder(spark))
    raw = gzip.open(warc.open_input(manifest.first().path)).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"\r\nWARC-Type: revisit") == 4
    assert read_warc(write_warc(spark.createDataFrame([], SCHEMA), warc_folder(spark))).count() == 0


def test_damage_is_noticed(spark):
    manifest = write_warc(spark.createDataFrame([(1, "u", "a" * 2000, "")], SCHEMA), warc_folder(spark), compress=False)
    path = local_path(manifest.first().path)
    with open(path, "r+b") as file:
        at = file.read().index(b"aaaa")
        file.seek(at)
        file.write(b"b")
    with pytest.raises(Exception, match="damaged"):
        read_warc(manifest).collect()


def test_local_exits():
    offsets = np.array([0, 10, 15, 30, 40])
    assert local_exits(offsets, np.array([10, 30, 33, 60, 70]), 50).tolist() == [60, 60, 33, 60, 70]
