import subprocess
import sys

import pytest

from loomstore.plans import shared


@pytest.mark.parametrize("master,given,want", [("local[4]", "", "/wh/_shared"), ("local", "", "/wh/_shared"), ("local-cluster[2,1,900]", "/s/", "/s"), ("spark://host:7077", "hdfs:///s", "hdfs:///s"), ("spark://host:7077", "", None), ("local-cluster[2,1,900]", "", None)])
def test_a_cluster_must_name_its_shared_folder(master, given, want):
    class Session:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: {"spark.checkpoint.dir": given} if given else {})  # noqa: N815

        conf = {"spark.sql.warehouse.dir": "/wh/"}

    Session.sparkContext.master = master
    if want is None:
        with pytest.raises(ValueError):
            shared.shared_dir(Session)
    else:
        assert shared.shared_dir(Session) == want


def test_written_tables_go_with_the_application(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from loomstore.plans.shared import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
assert materialize(spark.range(5), "x").count() == 5 and materialize(spark.range(0), "y").count() == 0
import os
assert sorted(n[:2] for n in os.listdir("{tmp_path}/shared") if n[1] == "-") == ["x-", "y-"]
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    assert not [p for p in (tmp_path / "shared").iterdir() if p.name[1] == "-"]
