"""Payment webhooks of four processors as one ``payment`` event stream."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.values import compute_once
from eventloom.sources.ingest import parse_time

# fixed values: event kinds that mean money moved, per provider
KINDS = {"stripe": ("checkout.session.completed", "invoice.paid", "invoice.payment_succeeded", "payment_intent.succeeded"),
         "lemonsqueezy": ("order_created", "subscription_payment_success"), "polar": ("order.created", "order.paid"), "dodo": ("payment.succeeded",)}
# fixed values: metadata keys that name the person, in order
IDENTITY_KEYS = ("distinct_id", "distinctId", "user_id", "userId")


# fixed values: where each provider keeps a field (first non-null wins)
FIELDS = {
    "event": {"stripe": "$.id", "lemonsqueezy": "$.data.id", "polar": "$.data.id", "dodo": "$.data.payment_id"},
    "kind": {"stripe": "$.type", "lemonsqueezy": "$.meta.event_name", "polar": "$.type", "dodo": "$.type"},
    "minor": {"stripe": ("$.data.object.amount_total", "$.data.object.amount_paid"), "lemonsqueezy": "$.data.attributes.total",
              "polar": ("$.data.net_amount", "$.data.amount"), "dodo": ("$.data.settlement_amount", "$.data.total_amount")},
    "currency": {"stripe": "$.data.object.currency", "lemonsqueezy": "$.data.attributes.currency", "polar": "$.data.currency", "dodo": "$.data.currency"},
    "at": {"stripe": "$.created", "lemonsqueezy": "$.data.attributes.created_at", "polar": "$.data.created_at", "dodo": "$.data.created_at"},
    "reference": {"stripe": "$.data.object.client_reference_id"},
    "meta": {"stripe": "$.data.object.metadata", "lemonsqueezy": "$.meta.custom_data", "polar": "$.data.metadata", "dodo": "$.data.metadata"},
    "customer": {"stripe": "$.data.object.customer", "lemonsqueezy": "$.data.attributes.customer_id", "polar": "$.data.customer.id", "dodo": "$.data.customer.customer_id"},
    "email": {"stripe": ("$.data.object.customer_email", "$.data.object.customer_details.email"), "lemonsqueezy": "$.data.attributes.user_email",
              "polar": "$.data.customer.email", "dodo": "$.data.customer.email"},
}
TYPES = {"minor": "double", "meta": "variant"}


def _field(name: str) -> Column:
    """The field under the row's own provider."""
    kind, out = TYPES.get(name, "string"), None
    for provider, paths in FIELDS[name].items():
        got = [F.try_variant_get("_v", p, kind) for p in ((paths,) if isinstance(paths, str) else paths)]
        if kind == "string" and len(got) > 1:
            got = [F.when(g != "", g) for g in got]
        out = (F.when if out is None else out.when)(F.col("provider") == provider, F.coalesce(*got))
    return out


def payments(landing: DataFrame) -> DataFrame:
    """landing(provider, body) → payments; pings, zero amounts and rows nobody can be named for are dropped.

    One pass over the bodies: every field is a branch on the provider.
    """
    d = compute_once(landing, _v=F.try_parse_json("body")).where("_v is not null")
    d = compute_once(d, **{f: _field(f) for f in FIELDS})
    wanted = reduce(lambda a, b: a | b, [(F.col("provider") == p) & F.col("kind").isin(*ks) for p, ks in KINDS.items()])
    d = d.where(wanted & (F.col("minor") > 0))
    own = F.array(*[F.struct(F.try_variant_get("meta", f"$.{k}", "string").alias("who"), F.lit(f"metadata.{k}").alias("how")) for k in IDENTITY_KEYS])
    tail = F.array(F.struct(F.col("customer").alias("who"), F.lit("provider_customer_id").alias("how")), F.struct(F.col("email").alias("who"), F.lit("email").alias("how")))
    first = F.array(F.struct(F.col("reference").alias("who"), F.lit("metadata.distinct_id").alias("how")))
    ident = F.filter(F.concat(first, own, tail), lambda x: x["who"] != "")        # precedence order
    d = d.withColumn("_i", F.get(ident, F.lit(0))).where("_i is not null")
    prefix = F.when(F.col("provider") == "lemonsqueezy", F.concat("kind", F.lit(":"))).when(F.col("provider") == "stripe", "").otherwise(F.concat("provider", F.lit(":")))
    return d.select(F.concat(prefix, "event").alias("id"), F.lit("payment").alias("name"), F.col("_i.who").alias("distinct_id"), parse_time(F.col("at")).alias("timestamp"),
                    "provider", "kind", (F.col("minor") / 100).alias("amount"), F.upper(F.coalesce("currency", F.lit(""))).alias("currency"), F.col("_i.how").alias("identity_source"))
