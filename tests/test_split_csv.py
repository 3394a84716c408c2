import csv
import random

import pytest

from lexitilt.sources import split_csv, tables

READER = dict(header=True, multiLine=True, escape='"', quote='"')


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000b", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def one_task(spark, path):
    return sorted((tuple(r) for r in spark.read.options(**READER).csv(path).collect()), key=repr)


def many_tasks(spark, path):
    header = spark.read.options(**READER).csv(path).columns
    return sorted((tuple(r)[:-1] for r in split_csv.read(spark, path, header).collect()), key=repr)


def write(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, **{"lineterminator": "\n", **options})
        out.writerow(["a", "b", "c"])
        out.writerows(rows)
    return str(path)


def odd_rows(n, seed):
    draw = random.Random(seed)
    cell = ["plain", "", 'quote " inside', 'two "" of them', '"', "a,b", "line\nbreak", "\n\n", ",\n,",
            '"\n"', 'ends with "', "é ü 日本", "x" * 300, "many\nlines " * 30, '","', " ", '"a",\n"b"']
    return [(k, draw.choice(cell), draw.choice(cell) + draw.choice(cell)) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"quoting": csv.QUOTE_ALL}])
def test_rows_equal_those_of_one_task(small_splits, tmp_path, options):
    path = write(tmp_path / "t.csv", odd_rows(400, 1), **options)
    got = many_tasks(small_splits, path)
    assert got == one_task(small_splits, path) and len(got) == 400
    lines = split_csv.lines_of(small_splits, path)
    assert lines.select("range").distinct().count() > 10


def test_a_record_over_many_splits(small_splits, tmp_path):
    rows = [(1, "long\n" * 3000, "x"), (2, "b", 'c"d'), (3, "also\n,\n\"\n" * 900, ""), (4, "e", "f")]
    path = write(tmp_path / "t.csv", rows)
    assert many_tasks(small_splits, path) == one_task(small_splits, path)


def test_hostile_quotes(small_splits, tmp_path):
    lines = ['a,b,c', '1,5" disk,x', '2,"closed"late,y', '3,"x" ,z', '4,ab"c"d,"q\nr"', '5,"",', '6,""x,w',
             '7,"a""b\n""c",v', '8, "blank first",u', "", '9,"two\n\nbreaks",t', '10,only', '11,a,b,c,d']
    body = "\n".join(lines[:1] + lines[1:] * 60) + "\n"
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write(body)
    assert many_tasks(small_splits, path) == one_task(small_splits, path)


def test_several_files_and_carriage_returns(small_splits, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        write(folder / f"{k}.csv", odd_rows(60, k))
    assert many_tasks(small_splits, str(folder)) == one_task(small_splits, str(folder))
    path = write(tmp_path / "r.csv", [(k, "plain", "p,q") for k in range(300)], lineterminator="\r\n")
    assert many_tasks(small_splits, path) == one_task(small_splits, path)


def test_order_and_types_of_the_table_reader(small_splits, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["job_id", "title", "med_salary"])
        out.writerows([(f"{k}.0", f"t\n{k}", k / 2 if k % 3 else "") for k in range(500)])
    df = tables.read_table(small_splits, path, order_col="at")
    rows = df.orderBy("at").collect()
    assert [r.job_id for r in rows] == list(range(500))
    assert [r.med_salary for r in rows] == [k / 2 if k % 3 else None for k in range(500)]
    assert rows[7].title == "t\n7" and len({r.at for r in rows}) == 500
    assert tables.read_table(small_splits, path, ["job_id"], nrows=3).count() == 3


@pytest.mark.parametrize("line,ends", [
    ("a,b", (0, 1)), ('"a', (1, 0)), ('a"', (0, 0)), ('","', (0, 1)), ('"a""b"', (0, 0)), ("", (0, 1)),
    ('"a","b', (1, 1)), ('x,"', (1, 0)), ('"a"b,"c"', (0, 0))])
def test_lines_as_maps_of_states(line, ends):
    assert (split_csv.state_after(line, 0), split_csv.state_after(line, 1)) == ends
