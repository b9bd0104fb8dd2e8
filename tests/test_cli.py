import pytest

from textrine.cli import main


def test_tree_and_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("banana")
    path = str(tmp_path / "in")
    got = main(["tree", "-t", "SL", "-a", "M", "-b", "T", "-d", str(tmp_path / "log"), path], spark)
    row = got["stats"].first()
    assert (row.branching_nodes, row.edges, row.used_bytes, row.used) == (4, 10, 7 * 4 + 4 * 20, "108 B") and got["log"].count() == 12
    assert spark.read.text(str(tmp_path / "log")).count() == 12
    assert main(["tree", "-t", "LA", "-a", "P", "-b", "C", path], spark)["stats"].first().la_cells == 7 + 2 * 3
    got = main(["window", "-t", "SH", "-a", "U", "-b", "T", "-k", "2", "-A", "2", "-v", path], spark)
    assert got["snapshots"].count() == 2 and got["stats"].first().observations == 3 and got["log"].count() > 0
    with pytest.raises(ValueError):
        main(["tree", "-t", "LA", "-a", "M", "-b", "C", path], spark)
