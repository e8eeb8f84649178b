"""Ad-hoc SQL over the events: Spark SQL on a production-scoped relation.

The dialect is Spark's own, with the helpers of ``functions.sql_helpers`` where the events' semantics differ.  What a query
may do is decided on its parsed plan, not on its text: it reads {events} and its own WITH names, each where it is in scope,
and calls built-in functions that compute on values.
"""
from __future__ import annotations

import uuid
from functools import cache

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from eventloom.functions.sql_helpers import HELPERS, register
from eventloom.operators.scope import scope_production

CATALYST = "org.apache.spark.sql.catalyst"
#: Built-in functions that reach beyond their arguments: Java code, files, the session and its user.
REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "from_protobuf", "to_protobuf", "current_user", "user", "session_user",
           "current_catalog", "current_database", "current_schema", "version"}
#: Functions that make rows out of their arguments.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


@cache
def _built_in(jvm) -> frozenset[str]:
    known = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
    return frozenset(known.apply(i).funcName().lower() for i in range(known.size()))


def _check(spark: SparkSession, query: str, events: str) -> bool:
    """Refuses all but queries over ``events`` and their own WITH names; says whether an ``env`` column is named."""
    if "${" in query:
        raise ValueError("variables are not substituted")      # the parser would put settings in before there is a plan
    gateway = spark.sparkContext._gateway
    of = lambda n, kind: is_instance_of(gateway, n, f"{CATALYST}.{kind}")
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    functions = (_built_in(spark._jvm) | set(HELPERS)) - REFUSED
    env = False
    todo = [(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset((events,)))]
    while todo:
        n, names = todo.pop()
        kind = n.getClass().getSimpleName()
        if of(n, "plans.logical.Command") or of(n, "plans.logical.ParsedStatement") or of(n, "plans.logical.ScriptTransformation"):
            raise ValueError("only SELECT is supported")
        if "UnresolvedIdentifier" in kind:
            raise ValueError("names are written out, not computed")
        if kind == "UnresolvedFunction" or kind == "UnresolvedTableValuedFunction":
            parts = items(n.nameParts() if kind == "UnresolvedFunction" else n.name())
            allowed = functions if kind == "UnresolvedFunction" else TABLE_FUNCTIONS
            if len(parts) > 1 or parts[0].lower() not in allowed:
                raise ValueError(f"function {'.'.join(parts)} is not available")
        elif kind == "UnresolvedWith":
            own = names
            for c in items(n.cteRelations()):                   # a name is known to what follows it, not to itself
                inside = own | {c._1().lower()} if n.allowRecursion() else own
                todo.append((c._2(), inside))
                own = own | {c._1().lower()}
            todo += [(x, own) for x in items(n.children())]
            continue
        elif kind == "UnresolvedRelation":
            name = ".".join(items(n.multipartIdentifier())).lower()
            if name not in names:
                raise ValueError(f"only {{events}} can be read, not {name}")
        elif kind == "UnresolvedAttribute":
            env |= items(n.nameParts())[-1].lower() == "env"
        below = items(n.children())
        if of(n, "plans.logical.LogicalPlan"):
            below += items(n.innerChildren()) + items(n.expressions())
        todo += [(x, names) for x in below]
    return env


def sql(df: DataFrame, query: str, cap: int | None = None) -> DataFrame:
    """Run ``query`` over {events}; non-production rows are hidden unless the query names the column ``env``.

    ``cap``: rows returned at most; all by default.
    """
    spark = df.sparkSession
    events = f"events_{uuid.uuid4().hex}"                       # a name that no table of the session has
    rel = df if _check(spark, query.replace("{events}", events), events) else scope_production(df)
    register(spark)
    out = spark.sql(query, events=rel)
    return out.limit(cap) if cap else out
