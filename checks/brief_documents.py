"""Brief documents for the checks, written so that Spark and DuckDB read the same expression.

Made per seller from seller_id, orders_fulfilled, items_sold and revenue. The remainder of
seller_id by 15 plants a defect:

 0 no closing brace          5 four actions            10 list instead of object
 1 two keys missing          6 no risk                 11 sound, priorities out of order
 2 caveat present but null   7 three risks             12 sound, priorities out of order
 3 unknown status            8 action without priority
 4 two findings              9 extra key in a finding         13 priority 1.5, 14 priority "2"
"""

_ID = "cast(seller_id as string)"
_KIND = "(seller_id % 15)"


def _when(kind: int, then: str, otherwise: str) -> str:
    return f"case when {_KIND} = {kind} then '{then}' else '{otherwise}' end"


def _finding(label: str, number: str, extra: str = "''") -> str:
    return (
        f"""'{{"label":"{label}","number":"' || cast({number} as string) || '","detail":"counted' || '"' """
        f"""|| {extra} || '}}'"""
    )


def _action(priority: str, name: str) -> str:
    return (
        f"""'{{' || {priority} || '"action":"{name} ' || {_ID} || '","reason":"target missed",' """
        f"""|| '"expected_impact":"fewer late items"}}'"""
    )


_FINDINGS = " || ',' || ".join(
    [_finding("orders", "orders_fulfilled"), _finding("items", "items_sold", _when(9, ',"unit":"pieces"', ""))]
)
_THIRD_FINDING = (
    f"case when {_KIND} = 4 then '' else ',' || {_finding('revenue', 'revenue')} end"
)
_SECOND_PRIORITY = (
    f"""case when {_KIND} = 8 then '' when {_KIND} = 13 then '"priority":1.5,' """
    f"""when {_KIND} = 14 then '"priority":"2",' else '"priority":2,' end"""
)
_ACTIONS = " || ',' || ".join([
    _action("'\"priority\":3,'", "review seller"),
    _action("'\"priority\":1,'", "call seller"),
    _action(_SECOND_PRIORITY, "audit stock of seller"),
])
_FOURTH_ACTION = f"""case when {_KIND} = 5 then ',' || {_action("'\"priority\":2,'", "warn seller")} else '' end"""

BRIEF_DOCUMENT = f"""
    {_when(10, '[{', '{')}
    || '"status":"' || {_when(3, 'Great', 'At risk')}
    || '","headline":"Seller ' || {_ID} || ' sold ' || cast(items_sold as string) || ' items'
    || '","summary":"Revenue was ' || cast(revenue as string)
    || '","findings":[' || {_FINDINGS} || {_THIRD_FINDING} || ']'
    || case when {_KIND} = 1 then ''
            when {_KIND} = 6 then ',"risks":[]'
            when {_KIND} = 7 then ',"risks":["delay","price","stock"]'
            else ',"risks":["delay","price"]' end
    || ',"actions":[' || {_ACTIONS} || {_FOURTH_ACTION} || ']'
    || case when {_KIND} = 1 then ''
            when {_KIND} = 2 then ',"caveat":null'
            else ',"caveat":"Delivered items only."' end
    || case when {_KIND} = 0 then '' when {_KIND} = 10 then '}}]' else '}}' end
"""


# A sound document, and what is changed in it to break one rule each; the number of a change is
# the remainder of seller_id by the number of changes. The first leaves it sound.
_SOUND = f"""
    '{{"status":"Stable","headline":"Seller ' || {_ID} || '","summary":"sound","findings":['
    || '{{"label":"orders","number":"1","detail":"counted"}},{{"label":"items","number":"2","detail":"counted"}},'
    || '{{"label":"revenue","number":"3","detail":"summed"}}],"risks":["delay","price"],"actions":['
    || '{{"priority":1,"action":"call","reason":"late","expected_impact":"fewer"}},'
    || '{{"priority":2,"action":"audit","reason":"stock","expected_impact":"less"}},'
    || '{{"priority":3,"action":"warn","reason":"price","expected_impact":"none"}}],"caveat":"given"}}'
"""
CHANGES = [
    ("sound", "sound"),
    ('"caveat":"given"}', '"caveat":"given"'),
    ('"status":"Stable",', ""),
    ('"status":"Stable"', '"status":"Great"'),
    ('"status":"Stable"', '"status":1'),
    ('"headline":', '"heading":'),
    ('"summary":"sound"', '"summary":null'),
    ('"caveat":"given"', '"caveat":["given"]'),
    (',"caveat":"given"', ""),
    (',{"label":"revenue","number":"3","detail":"summed"}', ""),
    ('"detail":"summed"}', '"detail":"summed"},{"label":"x","number":"4","detail":"y"}'),
    ('"label":"items",', ""),
    ('"number":"2"', '"number":2'),
    ('"detail":"summed"', '"detail":"summed","unit":"pieces"'),
    ('"findings":[{', '"findings":["no object",{'),
    ('["delay","price"]', "[]"),
    ('["delay","price"]', '["a","b","c"]'),
    ('["delay","price"]', '["a",2]'),
    ('["delay","price"]', '"delay"'),
    ('"priority":2', '"priority":4'),
    ('"priority":2', '"priority":"2"'),
    ('"priority":2', '"priority":1.5'),
    ('"priority":1,', ""),
    ('"reason":"stock"', '"reason":false'),
    ('"expected_impact":"none"', '"expected_impact":"none","owner":"me"'),
    ('"action":"warn"', '"act":"warn"'),
    ('"caveat":"given"', '"caveat":"given","status":"Stable"'),
    ('"caveat":"given"', '"caveat":"given","note":"more","extra":1'),
    ('"actions":[{', '"actions":{"list":[{'),
]


def _changed() -> str:
    kind = f"(seller_id % {len(CHANGES)})"
    cases = " ".join(f"when {n} then replace({_SOUND}, '{old}', '{new}')" for n, (old, new) in enumerate(CHANGES))
    return f"case {kind} {cases} end"


CHANGED_DOCUMENT = _changed()
