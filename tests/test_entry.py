"""The entry module imports with nothing but Python: no jar, JVM or package file is read."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_reads_no_file():
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import pyspark.sql.functions, pyspark.ml, zipfile, glob, importlib.resources
def refuse(*a, **k):
    raise AssertionError("file access at import")
zipfile.ZipFile = glob.glob = importlib.resources.files = refuse
import __spark_entry__ as e
assert len(e.queries()) > 80
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/")


def test_stop_list_is_spark_s(spark):
    from pyspark.ml.feature import StopWordsRemover
    from moodspark.functions.stopwords import english_stop_words
    assert list(english_stop_words()) == [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]
