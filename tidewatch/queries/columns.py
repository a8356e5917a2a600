"""Declared columns of the tables that the source queries land and register."""


def _columns(**types: str) -> list[dict]:
    return [{"name": name, "type": declared} for name, declared in types.items()]


CUSTOMER = _columns(
    c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string"
)
EVENTS = _columns(
    event_id="bigint", ts="timestamp", user_id="bigint", event_type="string", value="double", props="string"
)
ORDERS = _columns(
    o_orderkey="bigint",
    o_custkey="bigint",
    o_orderstatus="string",
    o_totalprice="double",
    o_orderdate="timestamp",
    o_orderpriority="string",
)
PART = _columns(
    p_partkey="bigint", p_name="string", p_brand="string", p_type="string", p_size="int", p_retailprice="double"
)
LINEITEM = _columns(
    l_orderkey="bigint",
    l_partkey="bigint",
    l_suppkey="bigint",
    l_linenumber="int",
    l_quantity="double",
    l_extendedprice="double",
    l_discount="double",
    l_tax="double",
    l_returnflag="string",
    l_linestatus="string",
    l_shipdate="timestamp",
)
# The ACID family names long integers and zoned timestamps differently.
ORDERS_RUN = _columns(o_orderkey="long", o_custkey="long", o_orderstatus="string", o_totalprice="double")
EVENTS_RUN = _columns(event_id="long", user_id="long", event_type="string", value="double")
