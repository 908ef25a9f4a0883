"""DuckDB spellings of the canonical forms, shared by the oracle queries."""

from __future__ import annotations


def _quad(n: str) -> str:
    return "||'.'||".join(f"(({n}) // {d} % 256)::varchar" for d in (16777216, 65536, 256, 1))


def _hex4(s: str) -> str:
    """A group of up to four hexadecimal digits as a number."""
    padded = f"lpad({s}, 4, '0')"
    return "+".join(f"(strpos('0123456789abcdef', substr({padded}, {i}, 1)) - 1) * {16 ** (4 - i)}" for i in (1, 2, 3, 4))


def host(c: str) -> str:
    s = f"lower(regexp_replace({c}, '\\s+', '', 'g'))"
    pre = r"(?:::|(?:0{1,4}:){5})ffff:"
    dotted = (
        f"regexp_replace(regexp_extract({s}, '^\\[?(?:{pre})?(\\d+\\.\\d+\\.\\d+\\.\\d+)\\]?(?::\\d{{1,5}})?(?:/\\d{{1,3}})?$', 1),"
        r" '(^|\.)0+([0-9])', '\1\2', 'g')"
    )
    octets = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
    mapped = f"^\\[?{pre}([0-9a-f]{{1,4}}):([0-9a-f]{{1,4}})\\]?(?:/\\d{{1,3}})?$"
    number = f"({_hex4(f"regexp_extract({s}, '{mapped}', 1)")}) * 65536 + ({_hex4(f"regexp_extract({s}, '{mapped}', 2)")})"
    return (
        f"case when regexp_matches({dotted}, '{octets}') then {dotted}"
        f" when regexp_matches({s}, '{mapped}') then {_quad(number)}"
        f" when regexp_matches({s}, '^\\d{{7,10}}$') and try_cast({s} as bigint) <= 4294967295 then {_quad(f'try_cast({s} as bigint)')} end"
    )


def flow_id(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def millis(c: str) -> str:
    return f"case when not isnan({c}) and abs({c}) < 1e15 then cast(round(case when abs({c}) >= 1e11 then {c} else {c} * 1000.0 end) as bigint) end"


def flow_state(columns: str = "") -> str:
    """A CTE body: flow_state with canonical keys and the interval in ms."""
    a, b = millis("first_seen"), millis("last_seen")
    return f"""
      select *, case when a is not null then least(a, coalesce(b, a)) end as start_ms,
             case when a is not null then greatest(a, coalesce(b, a)) end as end_ms
      from (select state_id, {host('src_ip')} as src_host, {host('dst_ip')} as dst_host, {flow_id('flow_id')} as fid,
                   src_port, dst_port, packet_count, label, protocol, {a} as a, {b} as b{columns} from flow_state)"""


def packet_event() -> str:
    return f"""
      select event_seq, packet_id, {host('src_ip')} as src_host, {host('dst_ip')} as dst_host, {flow_id('flow_id')} as fid,
             payload_len_raw, {millis('"timestamp"')} as at_ms, src_port, dst_port, flow_label, protocol from packet_event"""
