"""The session helper obeys what is set outside."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import json
from curbscope.session import get_spark
s = get_spark()
print("CONF " + json.dumps([s.sparkContext.master, s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.sql.session.timeZone")]))
"""


def conf_of(submit_args):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": submit_args, "BENCH_CPUS": "2"}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return json.loads(next(x for x in out.splitlines() if x.startswith("CONF "))[5:])


def test_preset_configuration_survives():
    preset = ("--master local[3] --conf spark.sql.shuffle.partitions=77 --conf spark.sql.session.timeZone=Asia/Tokyo "
              "--conf spark.ui.enabled=false pyspark-shell")
    assert conf_of(preset) == ["local[3]", "77", "Asia/Tokyo"]
    assert conf_of("--conf spark.ui.enabled=false pyspark-shell") == ["local[2]", "2", "UTC"]
