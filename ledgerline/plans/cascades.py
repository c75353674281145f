"""Queries of what follows along links: cross-defaults, and trees with sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import both, view
from ..operators import defaults, documents, graph
from .registry import query

CROSS = """select id as source_id, company_id, case when id % 4 = 0 then null else lead(id) over (partition by company_id order by id) end as target_id,
    case when id % 5 = 0 then 'pari_passu' when id % 5 < 3 then 'cross_acceleration' else 'cross_default' end as relationship, case when id % 8 = 0 then 20000000 when id % 4 = 0 then 30000000 end as threshold, id % 7 = 0 as is_bilateral from instruments"""
#: Which default brings which, pair by pair.
EDGES = f"""x as ({CROSS}), live as (select id, company_id, outstanding from instruments where is_active), u as (select x.* from x join live on live.id = x.source_id where relationship <> 'pari_passu'),
    e as (select target_id as src, source_id as dst from u where target_id in (select id from live) union select source_id, target_id from u where is_bilateral and target_id in (select id from live)
        union select t.id, u.source_id from u join live t on t.company_id = u.company_id and t.outstanding > coalesce(u.threshold, 0) where u.target_id is null and t.id <> u.source_id),
    r as (select src as id, dst as reached, 1 as steps from e union select r.id, e.dst, r.steps + 1 from r join e on e.src = r.reached where r.steps < 40),
    best as (select id, reached, cast(min(steps) as bigint) as steps from r where id <> reached group by all)"""


@query(f"with recursive {EDGES} select id, reached, steps from best")
def default_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defaults.default_reach(both(spark, sf_dir, CROSS), view(spark, sf_dir, "instruments"))


@query(f"""
    with recursive {EDGES} select l.id, count(b.reached) as n, cast(coalesce(sum(t.outstanding), 0) as bigint) as amount, coalesce(max(b.steps), 0) as steps
    from live l left join best b on b.id = l.id left join live t on t.id = b.reached group by l.id""")
def default_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defaults.default_exposure(both(spark, sf_dir, CROSS), view(spark, sf_dir, "instruments"))


@query("""
    with recursive up as (select id, id as ancestor, 0 as distance from entities union all select up.id, e.parent_id, distance + 1 from up join entities e on e.id = up.ancestor where e.parent_id is not null)
    select id, ancestor, cast(distance as bigint) as distance from up""")
def every_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestry(view(spark, sf_dir, "entities").select("id", "parent_id"))


@query("""
    with recursive debt as (select concat('C', company_id) as id, sum(outstanding) as own from instruments where is_active group by company_id),
    down as (select id as top, id, 0 as depth from entities where parent_id is null union all select top, e.id, depth + 1 from down join entities e on e.parent_id = down.id)
    select top as id, count(*) as n_nodes, cast(max(depth) as bigint) as depth, cast(coalesce(sum(own), 0) as bigint) as debt from down left join debt on debt.id = down.id group by top""")
def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = view(spark, sf_dir, "instruments").where("is_active").groupBy(F.concat(F.lit("C"), "company_id").alias("id")).agg(F.sum("outstanding").alias("debt"))
    found = documents.tree_documents(view(spark, sf_dir, "entities").join(debt, "id", "left"), ["name", "debt"], sums=("debt",))
    text = F.regexp_replace("document", r'"(id|name)":"[^"]*"', "")  # brackets that are left are those of the tree
    # the depth of a node is the number of open lists around it
    marks = F.split(F.regexp_replace(text, r"[^\[\]]", ""), "")
    deepest = F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda a, m: F.struct((a["at"] + F.when(m == "[", 1).when(m == "]", -1).otherwise(0)).alias("at"), F.greatest(a["most"], a["at"] + F.when(m == "[", 1).otherwise(0)).alias("most")), lambda a: a["most"] - 1)
    return found.select("id", F.size(F.regexp_extract_all("document", F.lit('("children":)'), F.lit(1))).cast("bigint").alias("n_nodes"), deepest.cast("bigint").alias("depth"), F.get_json_object("document", "$.subtree_debt").cast("bigint").alias("debt"))
