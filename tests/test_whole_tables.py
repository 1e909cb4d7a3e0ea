"""Plans over all orders and all customers."""

from lodestream.plans import catalog


def test_days_of_all_orders(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.withColumn("o_orderkey", orders.o_orderkey + 3900).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["d3_dates_between"](spark, str(tmp_path))
    assert got.count() == 4 * orders.count() and got.select("o_orderkey").distinct().count() == orders.count()


def test_facts_of_all_customers(spark, sf):
    got = {r.place for r in catalog.QUERIES["m20_graph_facts"](spark, sf).where("kind = 'person'").collect()}
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    assert got == {k for k in keys if k // 20 % 4 == 0}
