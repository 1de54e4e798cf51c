import sys; import os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from tidewater.session import build_session
from tests.oracle_check import duck
spark = build_session("local[8]", 8, extra={"spark.checkpoint.dir": "/tmp/tw-tc-ckpt"})
import __spark_entry__ as e
qs, sqls = e.queries(), e.oracle_sql()
con = duck("/root/testdata/sf0.001")
def sp(t):
    s = t.simpleString()
    return {"tinyint":"i8","smallint":"i16","int":"i32","bigint":"i64","double":"f64","float":"f32","string":"str","boolean":"bool","date":"date"}.get(s, s)
def dk(t):
    s = str(t).upper()
    return {"TINYINT":"i8","SMALLINT":"i16","INTEGER":"i32","BIGINT":"i64","HUGEINT":"i128","DOUBLE":"f64","FLOAT":"f32","VARCHAR":"str","BOOLEAN":"bool","DATE":"date","DECIMAL":"dec"}.get(s.split("(")[0], s)
bad = 0
for name in sorted(sqls):
    try:
        df = qs[name](spark, "/root/testdata/sf0.001")
        a = {f.name: sp(f.dataType) for f in df.schema.fields}
        rel = con.sql(sqls[name])
        b = {c: dk(t) for c, t in zip(rel.columns, rel.types)}
    except Exception as ex:
        print("ERR", name, str(ex)[:120]); continue
    diff = {c: (a.get(c), b.get(c)) for c in set(a) | set(b) if a.get(c) != b.get(c)}
    if diff:
        bad += 1
        print("TYPES", name, diff)
print("mismatching", bad)
