"""Large files stay dealt over tasks."""

from headway.sources import csvrows, files


def test_lines_of_a_large_file_are_not_dealt_by_file(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "stops.txt").write_text("stop_id,stop_name\n" + "".join(f"S{i},n\n" for i in range(50)))
    rows = csvrows.split_rows(files.read_lines(spark, f"{tmp_path}/f/*.txt"))
    assert sorted(r["_row_number"] for r in rows.collect()) == list(range(2, 52))
    plan = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not [j for j in joins if "path#" in j or "table#" in j], joins
