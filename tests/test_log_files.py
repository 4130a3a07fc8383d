"""Log files read from their ends against whole reads."""

import io
import random

import pytest
from pyspark.sql import functions as F

from citeflow.sources import log_files
from citeflow.sources.logs import log_tail


def whole(data: bytes, limit: int):
    lines = [x for x in data.split(b"\n") if x.strip(b" ")]
    return [(i, x.decode(errors="replace")) for i, x in enumerate(lines[::-1][:limit], 1)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 10**6])
def test_any_block_size_gives_the_same_lines(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice(["é", "中", "a", " ", "\n", "\n\n", "😀", "\t"]) for _ in range(rng.randint(0, 60)))
        data = text.encode() + rng.choice([b"", b"\n", b"\xff\xc3"])
        for limit in (1, 3, 100):
            assert log_files.tail_lines(io.BytesIO(data), len(data), limit, block)[0] == whole(data, limit)


def test_bytes_read_do_not_grow_with_the_file(tmp_path):
    path = tmp_path / "big.log"
    with open(path, "wb") as f:
        for i in range(200_000):
            f.write(f"line {i} of a long log with ümläuts\n".encode())
    with open(path, "rb") as f:
        lines, read = log_files.tail_lines(f, path.stat().st_size, 300)
    assert lines[0] == (1, "line 199999 of a long log with ümläuts") and len(lines) == 300
    assert read <= 64 * 1024 and path.stat().st_size > 50 * read


def test_equals_the_tail_of_the_text(spark, tmp_path):
    texts = {"a": "one\n\n two \n   \nthree é", "b": "", "c": "\n\n", "d": "\n".join(f"l{i}" for i in range(700)) + "\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_text(text)
    (tmp_path / "_hidden").write_text("no log")
    got = log_files.log_file_tail(spark, str(tmp_path), 300)
    name = F.regexp_extract("path", "/([a-z])[.]log$", 1).alias("name")
    found = {}
    for r in got.select(name, "from_end", "value").orderBy("from_end").collect():
        found.setdefault(r["name"], []).append(r["value"])
    logs = spark.createDataFrame(list(texts.items()), "name string, text string")
    want = {}
    for r in log_tail(logs, "text", 300).orderBy(F.desc("index")).collect():
        want.setdefault(r["name"], []).append(r["value"])
    assert found == want and len(found["d"]) == 300
    assert log_files.log_file_tail(spark, str(tmp_path / "a.log"), 1).first()["value"] == "three é"
