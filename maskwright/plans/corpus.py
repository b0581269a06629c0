"""Inputs of the registered queries: the given tables, and texts derived from them in SQL.

``CORPUS_SQL`` makes one text per customer so that every recognizer has rows at every scale. The
same statement runs in Spark and in the checking database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.texts import dealt

CORPUS_SQL = """
select c_custkey as doc_id, case c_custkey % 20
 when 0 then 'Contact user' || k || '@example.com about order ' || k
 when 1 then 'SSN ' || lpad(cast(100 + k % 800 as string),3,'0') || '-' || lpad(cast(10 + k % 80 as string),2,'0') || '-' || lpad(cast(1000 + k % 8000 as string),4,'0')
 when 2 then 'Call (555) ' || lpad(cast(100 + k % 800 as string),3,'0') || '-' || lpad(cast(1000 + k % 8000 as string),4,'0') || ' on the phone'
 when 3 then 'card 4532-1234-5678-' || lpad(cast(k % 10000 as string),4,'0')
 when 4 then 'host 10.0.' || (k % 256) || '.' || (k % 200)
 when 5 then 'see https://ex.org/p/' || k || '?id=' || k || ' now'
 when 6 then 'AWS AKIA' || lpad(cast(k as string),16,'0')
 when 7 then 'api token ' || md5(cast(k as string))
 when 8 then 'bank account ' || lpad(cast(k as string),12,'1')
 when 9 then 'passport AB' || lpad(cast(k as string),7,'1')
 when 10 then 'licence D' || lpad(cast(k as string),8,'2')
 when 11 then 'staff' || k || '@company.com'
 when 12 then 'EMP' || lpad(cast(k as string),6,'0') || ' joined'
 when 13 then 'CONFIDENTIAL project AB-' || lpad(cast(k % 10000 as string),4,'0')
 when 14 then 'ref ' || lpad(cast(k as string),9,'3')
 when 15 then 'email u' || k || '@ex.org card 4532123456789012'
 when 16 then 'a' || k || '@x.org b@x.org c@x.org d@x.org e@x.org f@x.org'
 when 17 then 'email u' || k || '@ex.org from 2001:db8:0:0:0:0:0:' || (k % 9)
 when 18 then 'nothing here ' || (k % 100)
 else 'key sk-' || lpad(cast(k as string),48,'a') || ' and pk_live_' || lpad(cast(k as string),24,'b') end as text
 from (select c_custkey, c_custkey as k from {customer})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one templated text per customer. Customers are dealt out, as searching a text
    takes far longer than reading a key."""
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return spark.sql(CORPUS_SQL, customer=customers)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant ``ts`` (the file holds it without a zone; it is UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
