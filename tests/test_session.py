import importlib
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from lumenquote import session as S


def test_written_tables_are_read_back_and_cleared(spark):
    S.clear_written(spark)
    df = S.written(spark.createDataFrame([(1, "a"), (2, None)], "k int, t string"), "some")
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, None)]
    place = Path(S._tables(spark)[0].removeprefix("file://"))
    assert place.is_dir() and place.parent == Path(S.shared_folder(spark).removeprefix("file://"))
    assert S.clear_written(spark) == 1 and not place.exists() and S.clear_written(spark) == 0


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,512]", False), ("spark://x:7077", False), ("yarn", False)])
def test_no_folder_of_one_machine_on_a_cluster(master, local):
    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    assert S.is_local(spark) == local
    if not local:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.shared_folder(spark)


def test_a_fault_inside_the_subpackage_is_no_absence(monkeypatch):
    import __spark_entry__ as entry

    name = "lumenquote.llm"
    monkeypatch.setitem(sys.modules, name + ".queries", None)
    for broken, found in ((ModuleNotFoundError("x", name=name), True), (ModuleNotFoundError("x", name="regex"), False)):

        class Finder:
            @staticmethod
            def find_spec(module, path=None, target=None):
                if module.startswith(name):
                    raise broken

        for m in [m for m in sys.modules if m.startswith(name)]:
            monkeypatch.delitem(sys.modules, m)
        monkeypatch.setattr(sys, "meta_path", [Finder, *sys.meta_path])
        monkeypatch.delattr("lumenquote.llm", raising=False)
        if found:
            assert importlib.reload(entry).llm_queries is None and "p2_found" in entry.queries()
        else:
            with pytest.raises(ModuleNotFoundError):
                importlib.reload(entry)
