"""Dev tool: compare Spark and DuckDB column types of every oracle query."""
import sys
sys.path.insert(0, __import__('os').path.dirname(__import__('os').path.dirname(__import__('os').path.abspath(__file__))))
from dayspan.session import local_session
import __spark_entry__ as E
from oracle_check import duck_connection
spark = local_session(8, 8)
sf = sys.argv[1] if len(sys.argv) > 1 else '/root/testdata/sf0.001'
con = duck_connection(sf)
SP = {'int': 'INTEGER', 'bigint': 'BIGINT', 'double': 'DOUBLE', 'string': 'VARCHAR', 'date': 'DATE', 'boolean': 'BOOLEAN',
      'smallint': 'SMALLINT', 'tinyint': 'TINYINT', 'float': 'FLOAT', 'timestamp': 'TIMESTAMP'}
for name, sql in E.oracle_sql().items():
    df = E.queries()[name](spark, sf)
    st = dict(df.dtypes)
    rel = con.sql(sql)
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad = {c: (st[c], dt.get(c)) for c in st if SP.get(st[c], st[c]) != dt.get(c)}
    if bad:
        print(name, bad, flush=True)
print("done")
