import os
import random

import pytest

from tessella.sources import ranged
from tessella.sources.ranged import LinesReader, Range


def expected(path, shown):
    data, at, out = open(path, "rb").read(), 0, []
    for line in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
        out.append((shown, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out


def rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True)]


@pytest.mark.parametrize("end", [b"\n", b""])
def test_every_cut_gives_every_line_once(tmp_path, end):
    r = random.Random(1)
    for case in range(12):
        lines = ["".join(r.choice("aé🙂\r ") for _ in range(r.choice([0, 0, 1, 3, 40]))) for _ in range(r.randint(0, 30))]
        path = tmp_path / f"{case}{len(end)}.jsonl"
        path.write_bytes(b"\n".join(x.encode() for x in lines) + (end if lines else b""))
        want = expected(path, str(path))
        for split in (1, 2, 3, 7, 50, 10_000):
            for batch in (1, 5, 1000):
                assert rows(LinesReader({"path": str(path), "split": split, "batch": batch})) == want, (case, split, batch)


def test_small_ranges_share_a_task(tmp_path):
    for name, n in (("a", 1000), ("b", 30), ("c", 1)):
        (tmp_path / name).write_text("x\n" * n)
    reader = LinesReader({"path": str(tmp_path), "split": 10, "task": 500})
    tasks = reader.partitions()
    assert len(tasks) == 5 and sum(len(t.ranges) for t in tasks) == 207
    assert all(sum(x.end - x.begin for x in t.ranges) <= 500 for t in tasks)
    assert len(rows(reader)) == 1031
    assert len(LinesReader({"path": str(tmp_path), "split": 10, "task": 0}).partitions()) == 207


class Flaky(LinesReader):
    """Breaks before a chunk again and again, at random."""

    def __init__(self, options, seed, chance):
        super().__init__(options)
        self.random, self.chance, self.broken = random.Random(seed), chance, 0

    def opened(self, path, at):
        stream = super().opened(path, at)
        reader, whole = self, stream.read

        class Stream:
            def read(self, n):
                if reader.random.random() < reader.chance:
                    reader.broken += 1
                    raise OSError("lost")
                return whole(n)

            def close(self):
                stream.close()

        return Stream()


def test_reading_goes_on_where_it_broke(tmp_path):
    path = tmp_path / "x"
    path.write_text("\n".join(f"line {k} {'z' * (k % 17)}" for k in range(500)))
    for seed in range(20):
        reader = Flaky({"path": str(path), "split": 700, "batch": 64, "attempts": 50, "wait": 0.0}, seed, 0.3)
        assert rows(reader) == expected(path, str(path))
        assert reader.broken > 10
    with pytest.raises(OSError):
        rows(Flaky({"path": str(path), "attempts": 3, "wait": 0.0}, 1, 1.0))


def test_pauses_grow(tmp_path, monkeypatch):
    path = tmp_path / "x"
    path.write_text("a\n")
    pauses = []
    monkeypatch.setattr(ranged.time, "sleep", pauses.append)
    with pytest.raises(OSError):
        rows(Flaky({"path": str(path), "attempts": 3}, 1, 1.0))
    assert pauses == [3.0, 6.0]


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, text in (("a.jsonl", '{"i": 1}\n\n{"i": 2}\n'), ("e/b.jsonl", ' \n{"i": 3, "s": "é"}'), ("_SUCCESS", "no"), (".x.crc", "no"), ("e/empty", "")):
        (tmp_path / "d" / name).write_text(text)
    for path in (str(tmp_path / "d"), "file://" + str(tmp_path / "d")):
        got = ranged.read_objects(spark, path, "i int, s string", split=4).collect()
        assert sorted((os.path.basename(r.file), r.start, r.i, r.s) for r in got) == [("a.jsonl", 0, 1, None), ("a.jsonl", 10, 2, None), ("b.jsonl", 2, 3, "é")]
    both = ranged.read_lines(spark, [str(tmp_path / "d" / "a.jsonl"), str(tmp_path / "d" / "e")])
    assert both.count() == 5 and both.columns == ["file", "start", "value"]
    assert ranged.read_lines(spark, str(tmp_path / "d" / "e" / "empty")).count() == 0
    with pytest.raises(Exception, match="nothing|FileNotFound"):
        ranged.read_lines(spark, str(tmp_path / "nothing")).count()
    (tmp_path / "bad").write_text('{"i": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED"):
        ranged.read_objects(spark, str(tmp_path / "bad"), "i int").collect()
    assert Range("p", 1, 2).path == "p"
