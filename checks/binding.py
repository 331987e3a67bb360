"""The given tables seen as the six logical tables (FIXTURES.md, section 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.ordered import running
from sessionlake.session import configure
from sessionlake.workspace import written

DAY = 86400
SESSIONS_FROM = 1701388800  # 2023-12-01T00:00:00Z
MESSAGES_FROM = 1704067200  # 2024-01-01T00:00:00Z


def _case(*branches: tuple[Column, Column], default: Column | None = None) -> Column:
    first, *rest = branches
    chain = reduce(lambda c, b: c.when(*b), rest, F.when(*first))
    return chain.otherwise(default) if default is not None else chain


def raw_calls(session: Column, r: Column) -> Column:
    """The call array of a session's r-th response, with the white space and
    the number forms that a JSON writer would not keep."""
    s, n = session.cast("string"), r.cast("string")
    one = lambda call_id: F.concat(F.lit('[{"id":"'), call_id, F.lit('", "n":2.50}]'))
    two = F.concat(
        F.lit('[{"id":"tc-'), s, F.lit("-"), n, F.lit('", "n":2.50},  {"id":"tc-'), s, F.lit("-"), n,
        F.lit('b","n":1e3}]'),
    )
    return _case(
        (session % 6 == 3, one(F.lit("dup"))), (session % 6 == 2, one(F.lit("call-1"))), default=two
    )


class Bound:
    """The logical tables of one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def sessions(self) -> DataFrame:
        key = F.col("c_custkey")
        system = F.col("c_acctbal") < 0
        created = F.lit(SESSIONS_FROM) + key % 60 * DAY
        model = _case((key % 4 == 1, F.lit("model-a")), (key % 4 == 2, F.lit("model-b")),
                      (key % 4 == 3, F.lit("model-c")))
        metadata = _case(
            (key % 11 == 0, F.lit("{bad")), (key % 4 == 0, F.lit(None).cast("string")),
            default=F.to_json(F.struct(F.concat(F.lit("c"), key % 3).alias("channel"),
                                       (key % 7).cast("string").alias("n"))),
        )
        return self.table("customer").select(
            key.cast("string").alias("id"),
            F.when(key % 3 == 0, F.concat(F.lit("about "), key)).alias("summary"),
            F.when(key % 10 != 0, F.col("c_name")).alias("title"),
            model.alias("active_model"),
            metadata.alias("metadata"),
            F.col("c_nationkey").cast("string").alias("entity_id"),
            F.col("c_mktsegment").alias("group_id"),
            F.timestamp_seconds(created).alias("created_at"),
            F.timestamp_seconds(created + key % 24 * 3600).alias("updated_at"),
            F.when(system, "system").otherwise("chat").alias("interaction_kind"),
            F.when(system & (key % 2 == 0), "csv_mapping").alias("system_source"),
            F.when(~system & (key % 9 == 0), "welcome").alias("opened_by"),
        )

    def bind_events(self, given: DataFrame, calls: bool = False) -> DataFrame:
        """The event log. With `calls`, `given` also carries r, the rank of a
        response in its session, and before_id, the session's previous event."""
        # a step of its own, so that the JSON is parsed once for all its uses
        given = given.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
        k, kind, user = F.col("_k"), F.col("event_type"), F.col("user_id")
        event_type = _case(
            (kind == "purchase", F.lit("llm_response")), (kind == "click", F.lit("tool_call_result")),
            (kind == "error", F.lit("llm_error")),
            ((kind == "signup") & (k % 2 == 0), F.lit("tool_call_extracted")),
            (kind == "signup", F.lit("turn_start")),
            (k % 2 == 0, F.lit("tool_call_repair_invoked")), default=F.lit("retry"),
        )
        llm = F.to_json(F.struct(
            F.lit(3).alias("v"), k.alias("tokens_in"), F.floor(k / 2).alias("tokens_out"),
            F.when(k % 4 == 0, k).alias("cache_write_tokens"), F.when(k % 4 == 0, k * 2).alias("cache_read_tokens"),
            F.col("value").alias("cost_input"), (k / 100).alias("cost_output"),
            _case((k % 5 == 0, F.lit("USD")), (k % 5 == 1, F.lit("EUR")), (k % 5 == 2, F.lit(""))).alias("cost_currency"),
            F.when((user % 4 != 0) & (k % 3 == 0), k).alias("price"),
        ))
        if calls:
            llm = F.concat(F.substring(llm, F.lit(1), F.length(llm) - 1),
                           F.lit(',"native_tool_calls_raw": '), raw_calls(user, F.col("r")), F.lit("}"))
        of_call = F.to_json(F.struct(
            F.lit(1).alias("v"), F.concat(F.lit("tr-"), k % 10).alias("call_id"),
            F.when(k % 3 == 0, "error").otherwise("ok").alias("status"),
        ))
        payload = _case(
            (kind == "purchase", llm), (kind.isin("click", "signup"), of_call),
            (kind == "error", F.to_json(F.struct(F.repeat(F.lit("x"), k * 4).alias("response_body_excerpt")))),
            default=F.lit('{"v":1}'),
        )
        parent = F.when((kind == "purchase") & (k % 10 == 0), F.col("before_id").cast("string")) if calls \
            else F.lit(None).cast("string")
        return given.select(
            F.col("event_id").cast("string").alias("id"), user.cast("string").alias("session_id"),
            # event ids grow with time, so they serve as sequence numbers
            (F.col("event_id") + 1).alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
            event_type.alias("event_type"), parent.alias("parent_id"),
            F.when(k % 2 == 0, k.cast("bigint")).alias("duration_ms"),
            payload.alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    @property
    def events(self) -> DataFrame:
        return self.bind_events(self.table("events"))

    @property
    def events_with_calls(self) -> DataFrame:
        ranked = running(
            self.table("events"), ["user_id"], ["event_id"],
            sums={"r": (F.col("event_type") == "purchase").cast("bigint")}, previous={"before_id": "event_id"},
        )
        # a log is stored, not worked out on each reading
        return written(self.bind_events(ranked, calls=True), "events")

    @property
    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        own = F.concat(F.lit("tc-"), conv, F.lit("-"), turn)
        stored = lambda *ids: F.concat(
            F.lit("["), F.concat_ws(",", *[F.concat(F.lit('{"id":"'), i, F.lit('","name":"a__b","arguments":{}}'))
                                           for i in ids]), F.lit("]"))
        tool_calls = _case(
            (F.col("role") != "assistant", F.lit(None).cast("string")),
            (conv % 6 == 0, stored(own)), (conv % 6 == 1, stored(own, F.concat(own, F.lit("b")))),
            (conv % 6 == 2, stored(F.lit("call-1"))), (conv % 6 == 3, stored(F.lit("dup"))),
            (conv % 6 == 5, stored(own, F.lit("gone"))),
            (turn % 3 == 0, F.lit("[]")), (turn % 3 == 1, F.lit('[{"id":')),
        )
        metadata = _case(
            ((conv + turn) % 5 == 1, F.lit("")),
            ((conv + turn) % 5 == 2, F.concat(F.lit(' {"prompt_type": "confirm", "n":'), turn, F.lit(".50}\n"))),
            ((conv + turn) % 5 == 3, F.lit("{bad")), ((conv + turn) % 5 == 4, F.lit("{}")),
        )
        return self.table("conversations").select(
            conv.cast("string").alias("session_id"), (turn + 1).alias("seq"), "role", F.col("text").alias("content"),
            tool_calls.alias("tool_calls"),
            F.when((F.col("role") == "user") & (turn % 2 == 0), F.concat(F.lit("tr-"), turn)).alias("tool_call_id"),
            metadata.alias("metadata"),
            F.when(F.col("role") == "system", "hidden").alias("visibility"),
            F.timestamp_seconds(F.lit(MESSAGES_FROM) + turn * 4 * DAY + conv * 60).alias("created_at"),
        )

    @property
    def snapshots(self) -> DataFrame:
        docs = self.table("documents").withColumn("sha256", F.sha2("text", 256))
        first = F.min_by(F.struct("source", "text"), F.col("doc_id"))
        return docs.groupBy("sha256").agg(first.alias("d")).select(
            "sha256", F.col("d.source").alias("kind"), F.col("d.text").alias("content"),
            F.timestamp_seconds(F.lit(MESSAGES_FROM)).alias("created_at"),
        )

    @property
    def debug_events(self) -> DataFrame:
        page = F.col("page_id")
        return self.table("pages").select(
            page.cast("string").alias("id"), (page % 10).cast("string").alias("session_id"),
            F.when(page % 4 != 0, F.concat(F.lit("tr-"), page)).alias("trace_id"),
            F.timestamp_seconds(F.lit(MESSAGES_FROM) + F.floor(page / 40)).alias("ts"),
            _case((F.floor(page / 10) % 3 == 0, F.lit("request")), (F.floor(page / 10) % 3 == 1, F.lit("response")),
                  default=F.lit("error")).alias("direction"),
            F.when(F.floor(page / 10) % 3 == 1, F.lit(200)).alias("status"),
            F.when(page % 7 != 0, F.col("url")).alias("url"), F.col("html").alias("body"),
        )

    @property
    def usage(self) -> DataFrame:
        kind = _case((F.col("o_orderstatus") == "F", F.lit("chat")), (F.col("o_orderstatus") == "O", F.lit("system")),
                     default=F.lit("job"))
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("entity_id"),
            F.col("o_orderpriority").alias("group_id"), kind.alias("interaction_kind"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @property
    def star_sessions(self) -> DataFrame:
        """Orders as sessions: the largest join the given tables have."""
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("entity_id"),
            F.col("o_orderpriority").alias("group_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.lit("chat").alias("interaction_kind"),
        )

    @property
    def star_events(self) -> DataFrame:
        """Lineitems as the events of their order."""
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("session_id"),
            F.col("l_linenumber").cast("bigint").alias("seq"), F.col("l_shipdate").cast("timestamp").alias("ts"),
            _case((flag == "R", F.lit("llm_response")), (flag == "A", F.lit("tool_call_result")),
                  default=F.lit("retry")).alias("event_type"),
            F.concat(
                F.lit('{"tokens_in":'), F.col("l_quantity").cast("int"), F.lit(',"cost_input":'), F.col("l_extendedprice"),
                F.lit(',"cost_output":'), F.col("l_discount"),
                F.when(F.col("l_linenumber") == 1, ',"price":0.5}').otherwise("}"),
            ).alias("payload"),
        )
