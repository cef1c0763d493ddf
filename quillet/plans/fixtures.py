"""A small code corpus as a table of files, for queries over source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/app/routes.py": """import subprocess as sp
from . import store
from .guards import require_permission as need

@router.get("/run/{name}")
def run(name):
    need("run")
    return sp.run(store.command(name), shell=True)

class Admin:
    def drop(self, key):
        self.check_tenant(key)
        return store.delete(key)

    def check_tenant(self, key):
        return key.tenant_id == self.tenant_id
""",
    "src/app/store.py": """import os

def command(name):
    return "echo " + name

def delete(key):
    os.chmod(key.path, 0o777)
    return eval(key.text)
""",
    "src/app/broken.py": "def f(:\n",
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
