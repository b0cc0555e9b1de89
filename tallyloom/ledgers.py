"""Two ledgers made from the order table, with every kind of discrepancy, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The order key modulo 20 is the scenario: 0-9 exact, 10 amount and 11 date within tolerance, 12 amount and 13 date beyond,
#: 14 source only, 15 target only, 16 split, 17 consolidated, 18 repeated source, 19 half amount or other currency.
SOURCE_SQL = """
    select o_orderkey * 10 + leg as ordinal, 'ORD' || o_orderkey as ref,
           case o_custkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' else 'MAD' end as currency,
           cast(case when o_orderkey % 20 = 17 then case leg when 0 then round(amt * cast('0.37' as decimal(3,2)), 2) else amt - round(amt * cast('0.37' as decimal(3,2)), 2) end
                else amt end as decimal(18,2)) as amount,
           cast(o_orderdate as date) as value_date
    from (select *, cast(o_totalprice as decimal(18,2)) as amt from {orders}) o cross join (values (0), (1)) l(leg)
    where o_orderkey % 20 <> 15 and (leg = 0 or o_orderkey % 20 in (17, 18))
"""
TARGET_SQL = """
    select o_orderkey * 10 + leg as ordinal, 'ORD' || o_orderkey as ref,
           case when o_orderkey % 20 = 19 and o_orderkey % 40 = 39 then 'CHF'
                else case o_custkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' else 'MAD' end end as currency,
           cast(case o_orderkey % 20
                when 10 then amt + cast('3.00' as decimal(3,2))
                when 12 then round(amt * cast('1.20' as decimal(3,2)), 2)
                when 16 then case leg when 0 then round(amt * cast('0.37' as decimal(3,2)), 2) else amt - round(amt * cast('0.37' as decimal(3,2)), 2) end
                when 19 then case when o_orderkey % 40 = 39 then amt else round(amt * cast('0.50' as decimal(3,2)), 2) end
                else amt end as decimal(18,2)) as amount,
           case o_orderkey % 20 when 11 then cast(o_orderdate as date) + 2 when 13 then cast(o_orderdate as date) + 10 else cast(o_orderdate as date) end as value_date
    from (select *, cast(o_totalprice as decimal(18,2)) as amt from {orders}) o cross join (values (0), (1)) l(leg)
    where o_orderkey % 20 <> 14 and (o_orderkey % 20 <> 18 or o_orderkey % 40 = 18) and (leg = 0 or o_orderkey % 20 = 16)
"""


def ledgers(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target) with ordinal, ref, currency, amount, value_date."""
    spark = orders.sparkSession
    return spark.sql(SOURCE_SQL, orders=orders), spark.sql(TARGET_SQL, orders=orders)
