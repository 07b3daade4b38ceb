import csv
import random

import pytest

from reviewloom.operators import reduced_games
from reviewloom.schema import GAME_FIELDS
from reviewloom.sources import (
    as_result,
    clean_games,
    read_games,
    read_reviews,
    stream_reviews,
    write_buckets,
    write_copy,
    write_result,
)

HEADER = ["app_id", "app_name", "review_text", "review_score", "review_votes"]


def write_csv(path, rows, header=HEADER, end="\n"):
    with open(path, "w", newline="") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


def fields(row):
    """What a reader should give for one review record."""
    cells = [cell.replace("\r\n", "\n") for cell in row] + [None] * 4
    return tuple(cells[i] or None for i in (0, 2, 3)) + (len(row),)


def as_read(frame):
    rows = [
        tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in row)
        for row in frame.collect()
    ]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def review_files(tmp_path_factory):
    """Two files with quotes, commas, line breaks, ragged rows and blank lines."""
    folder = tmp_path_factory.mktemp("reviews")
    pick = random.Random(7)
    pieces = ['a', 'b"', "\n", ",", "é", "word ", "\r\n", "x" * 50, "", " ", '""']
    rows = []
    for i in range(300):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(0, 12)))
        rows.append([str(i), 'x, "y"\nz', text, pick.choice(["1", "-1", "0", ""]), "0"])
    rows[33] = rows[33][:3]
    rows[40] = ["40"]
    rows[41] = rows[41] + ["more", "and, more"]
    rows[42][2] = "long " * 400 + "\n" * 300 + '"end"'
    write_csv(folder / "a.csv", rows[:150])
    write_csv(folder / "b.csv", rows[150:], end="\r\n")
    with open(folder / "b.csv", "a", newline="") as file:
        file.write("\r\n")
    return str(folder), sorted(map(fields, rows), key=str)


def test_one_task_per_file(spark, review_files):
    folder, want = review_files
    assert as_read(read_reviews(spark, folder, layout="files")) == want


def test_size_does_not_choose_the_reader(spark, review_files):
    """Files are read one by one unless the caller names another layout."""
    folder, want = review_files
    frame = read_reviews(spark, folder)
    assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert as_read(frame) == want
    with pytest.raises(ValueError):
        read_reviews(spark, folder, layout="auto")


@pytest.mark.parametrize("block_bytes", [134217728, 700, 64])
def test_blocks(spark, review_files, block_bytes):
    """Records are put together wherever the blocks are cut."""
    folder, want = review_files
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert as_read(read_reviews(spark, folder, layout="blocks")) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


STRAY = """app_id,name,review_text,review_score
1,a,stray " quote,1
2,b,"quoted ""text"" with
a break, and ""more""
",1
3,c"c,5" screen,-1
4,"d","x ""y",1
5,e,plain,1
6,f,end",1
7,"g
","h

",-1
8,i,last,1
"""


@pytest.mark.parametrize("block_bytes", [134217728, 40, 16])
def test_stray_quotes_stay_local(spark, tmp_path, block_bytes):
    (tmp_path / "a.csv").write_text(STRAY)
    want = [
        ("1", 'stray " quote', "1", 4), ("2", 'quoted "text" with\na break, and "more"\n', "1", 4),
        ("3", '5" screen', "-1", 4), ("4", 'x "y', "1", 4), ("5", "plain", "1", 4),
        ("6", 'end"', "1", 4), ("7", "h\n\n", "-1", 4), ("8", "last", "1", 4),
    ]
    assert as_read(read_reviews(spark, str(tmp_path), layout="files")) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert as_read(read_reviews(spark, str(tmp_path), layout="blocks")) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("layout", ["files", "blocks"])
def test_long_fields(spark, tmp_path, layout):
    """Also in ragged records, whose fields are counted."""
    text = 'word, ""x"" ' * 60_000
    (tmp_path / "a.csv").write_text(f'a,b,c,d\n1,,"{text}",1,extra\n2,,"{text}\n{text}",1\n')
    got = read_reviews(spark, str(tmp_path), layout=layout)
    assert sorted((row.app_id, len(row.text), row.n_fields) for row in got.collect()) == [
        ("1", 600_000, 5), ("2", 1_200_001, 4)
    ]


@pytest.mark.parametrize("layout", ["files", "blocks", "lines"])
def test_whole_records_in_file_order(spark, tmp_path, layout):
    """Every column is copied, and a sample takes the first records of the file."""
    end = "\n" if layout == "lines" else '\n"q"'
    rows = [[str(50 - i), f"n{i}", f"t, {i}" if layout == "lines" else f"t,{end}{i}", "1", f"v{i}"] for i in range(50)]
    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a.csv", rows)
    read = read_reviews(spark, str(tmp_path / "in"), layout=layout, original=True, place=True)
    first = reduced_games(read, 7, "place")
    write_copy(first.select("original.*"), str(tmp_path / "out"))
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "out"))
    assert back.columns == HEADER
    assert sorted(map(list, back.collect())) == sorted(rows[:7])


def test_lines(spark, tmp_path):
    rows = [["1", "", 'a "b", c', "1", ""], ["2", "", "d", "-1", ""]]
    write_csv(tmp_path / "a.csv", rows)
    got = read_reviews(spark, str(tmp_path), layout="lines")
    assert as_read(got) == [("1", 'a "b", c', "1", 5), ("2", "d", "-1", 5)]
    with pytest.raises(ValueError):
        read_reviews(spark, str(tmp_path), layout="other")


def test_stream_equals_batch(spark, review_files, tmp_path):
    folder, want = review_files
    stream = stream_reviews(spark, folder, width=5, maxFilesPerTrigger=1)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "rows"))
    )
    query.awaitTermination()
    assert as_read(spark.read.parquet(str(tmp_path / "rows"))) == want


@pytest.mark.parametrize("layout", ["files", "blocks"])
def test_games(spark, tmp_path, layout):
    def game(width, **values):
        cells = ["x"] * width
        cells[29:30] = ["3"] if width > 29 else []
        for name, value in values.items():
            if GAME_FIELDS[name] < width:
                cells[GAME_FIELDS[name]] = value
        return cells

    common = {"release_date": "May 2020", "windows": "True", "mac": "False", "linux": "True"}
    rows = [
        game(39, app_id="1", name='The "A",\nB', genres="Indie,RPG", **common),
        game(39, app_id="2", name="C", genres="", **common),
        game(36, app_id="3", name="D", **common),
        game(37, app_id="4", name="E", genres="Action", **common),
    ]
    write_csv(tmp_path / "games.csv", rows, header=[f"h{i}" for i in range(39)])
    clean, quarantine = clean_games(read_games(spark, str(tmp_path), layout=layout))
    assert sorted(map(tuple, clean.collect())) == [
        (1, 'The "A",\nB', 2020, True, False, True, 3, ["Indie", "RPG"]),
        (4, "E", 2020, True, False, True, 3, ["Action"]),
    ]
    assert sorted((row.app_id, row.reason) for row in quarantine.collect()) == [
        ("2", "empty genres"), ("3", "width")
    ]


def test_copy_keeps_text(spark, tmp_path):
    rows = [(1, ' lead, "q"\nnext \\ trail '), (2, "\ttab"), (3, "plain")]
    frame = spark.createDataFrame(rows, "id int, text string")
    write_copy(frame, str(tmp_path / "copy"))
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(
        str(tmp_path / "copy")
    )
    assert sorted((int(row.id), row.text) for row in back.collect()) == rows


def test_result_files(spark, tmp_path):
    stats = spark.createDataFrame([(3, "A, b", 7)], "app_id bigint, name string, stat bigint")
    write_result(as_result(stats, 2), str(tmp_path), 2)
    parts = [part.read_text().splitlines() for part in (tmp_path / "2").glob("*.csv")]
    assert {part[0] for part in parts} == {"AppID,Name,Average playtime forever"}
    assert [line for part in parts for line in part[1:]] == ['3,"A, b",7']


def test_buckets(spark, tmp_path):
    frame = spark.createDataFrame([(i,) for i in range(7)], "app_id bigint")
    write_buckets(frame, str(tmp_path / "b"), "app_id", 3)
    assert sorted(p.name for p in (tmp_path / "b").glob("bucket=*")) == [
        "bucket=1", "bucket=2", "bucket=3"
    ]
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    assert {row.app_id: row.bucket for row in rows} == {i: i % 3 + 1 for i in range(7)}


def test_blocks_do_not_depend_on_later_splits(spark, tmp_path):
    """A read that is planned under one split size gives every row under another one."""
    rows = [[str(i), "n", f"text\n{i}" if i % 7 == 0 else f"text {i}", "1", "0"] for i in range(3000)]
    write_csv(tmp_path / "a.csv", rows)
    usual = {key: spark.conf.get(key) for key in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        frame = read_reviews(spark, str(tmp_path), layout="blocks")
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1777)
        assert as_read(frame) == sorted(map(fields, rows), key=str)
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)


def test_blocks_refuse_bare_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"app_id,n,t,s\r1,n,a,1\r2,n,b,1\r")
    with pytest.raises(Exception, match="bare carriage return"):
        read_reviews(spark, str(tmp_path), layout="blocks").collect()
