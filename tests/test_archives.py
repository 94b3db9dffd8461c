"""The ZIP source against the reader of unpacked files, and its partitions."""

import zipfile

import pytest

from wanderlake.sources import archives
from wanderlake.sources.trajectories import read_points


@pytest.fixture
def files(tmp_path):
    out = {}
    for user in ("000", "001", "017"):
        for day in range(4):
            rows = [f"{39 + day / 10},{116 + k / 1000},0,100,39000.5,2009-01-0{day + 1},00:{k // 60:02d}:{k % 60:02d}" for k in range(200)]
            rows += ["bad line", "39.1,x,0,1,1,2009-01-01,00:00:00", "95.0,116.0,0,1,1,not a day,00:00:00"]
            out[f"Data/{user}/Trajectory/2009010{day}.plt"] = "header\n" * 6 + "\r\n".join(rows) + "\n"
    out["Data/000/labels.txt"] = "Start Time\n"
    out["Data/empty.plt"] = ""
    for name, text in out.items():
        p = tmp_path / "plain" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    names = sorted(out)
    (tmp_path / "zips").mkdir()
    for k, part in enumerate((names[::2], names[1::2])):
        with zipfile.ZipFile(tmp_path / "zips" / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            z.mkdir("Data/nobody")
            for n in part:
                z.writestr(n, out[n])
    (tmp_path / "zips" / "none.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    return tmp_path


def rows(df):
    return sorted(map(str, df.collect()))


def test_archives_equal_unpacked_files(spark, files):
    want = rows(read_points(spark, str(files / "plain/Data/*/Trajectory/*.plt")))
    assert len(want) == 12 * 202
    for at, size in ((str(files / "zips"), 1), (f"file://{files}/zips", 1 << 20)):
        df = archives.read_zip_points(spark, at, range_bytes=size)
        assert rows(df) == want
        assert df.rdd.getNumPartitions() == (13 if size == 1 else 2)


def test_inventory_reads_the_directory_alone(spark, files):
    got = {r.member: r for r in archives.member_inventory(spark, str(files / "zips")).collect()}
    assert len(got) == 14 and not any(m.endswith("/") for m in got)
    r = got["Data/017/Trajectory/20090102.plt"]
    assert (r.user_id, r.trajectory_id) == ("017", "20090102.plt") and r.size == len((files / "plain" / r.member).read_bytes())
    assert got["Data/empty.plt"].size == 0


def test_summaries_of_trajectories(spark, files):
    s = {(r.user_id, r.trajectory_id): r for r in archives.summarize_trajectories(archives.read_zip_points(spark, str(files / "zips/1.zip"))).collect()}
    r = next(iter(s.values()))
    assert len(s) in (5, 6, 7) and r.points == 202 and r.valid_points == 200 and r.untimed == 1 and r.different_times == 200


def test_missing_archive(spark, files):
    with pytest.raises(Exception, match="nothing.zip"):
        archives.member_lines(spark, str(files / "nothing.zip")).count()


def test_archives_are_bounded_and_small_members_share_batches(spark, tmp_path):
    rows_in = spark.range(200).selectExpr("concat('d/', id % 40, '/t/', id, '.plt') as member", "explode(sequence(0, 2)) as place").selectExpr("member", "place", "concat('line ', place) as value")
    written = archives.write_zip(rows_in.coalesce(1), f"file://{tmp_path}/out", members=16).collect()
    assert sum(r.members for r in written) == 200 and max(r.members for r in written) == 16
    for r in written:
        assert len(zipfile.ZipFile(r.archive.removeprefix("file://")).namelist()) == r.members
    lines = archives.member_lines(spark, f"file://{tmp_path}/out")
    assert sorted(lines.select("member", "line_no", "value").collect()) == sorted(rows_in.selectExpr("member", "cast(place as long) as line_no", "value").collect())
    reader = archives.ZipReader({"path": str(tmp_path / "out")})
    # A batch an archive, not a batch a member.
    assert all(sum(1 for _ in reader.read(p)) == 1 for p in reader.partitions())


def test_lines_over_the_limit_of_a_batch(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k, n in enumerate((3, 0, 9, 4, 1)):
            z.writestr(f"{k}.txt", "".join(f"{k}:{i}\n" for i in range(n)))
    monkeypatch.setattr(archives, "LINES", 4)
    reader = archives.ZipReader({"path": str(tmp_path / "a.zip")})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [4, 4, 4, 4, 1]
    assert [(m, n, v) for b in batches for m, n, v in zip(*(b[c].to_pylist() for c in ("member", "line_no", "value")))] == [(f"{k}.txt", i, f"{k}:{i}") for k, n in enumerate((3, 0, 9, 4, 1)) for i in range(n)]
