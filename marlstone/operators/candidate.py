"""The shape of a candidate document as Spark types."""

_SUPPORT = "support: struct<basis: string, evidence_ids: array<string>>"
_STEXT = f"struct<text: string, {_SUPPORT}>"
_QTY = "struct<value: double, comparator: string, source_unit: string, normalized_unit: string>"
_CAD = "struct<interval: bigint, unit: string, alignment: string>"
_MONEY = "struct<amount: double, currency: string, comparator: string>"
_LINK = f"struct<role: string, url: string, {_SUPPORT}>"
_OPPORTUNITY = (
    f"struct<local_key: string, variant_label: {_STEXT}, plan_label: {_STEXT}, availability: struct<value: string, {_SUPPORT}>, effective_period: struct<`from`: string, `to`: string, {_SUPPORT}>, "
    f"entitlements: array<struct<key: string, kind: string, label: string, quantity: {_QTY}, cadence: {_CAD}, duration: struct<value: double, unit: string>, monetary_value: {_MONEY}, maximum_value: {_MONEY}, "
    f"percentage_value: struct<value: double, comparator: string>, cost_scope: string, applies_to: array<struct<target_type: string, source_label: string>>, {_SUPPORT}>>, "
    f"constraints: array<struct<key: string, kind: string, other_kind: string, label: string, target_key: string, quantity: {_QTY}, cadence: {_CAD}, {_SUPPORT}>>, "
    f"conditions: array<struct<key: string, family: string, kind: string, required: boolean, credential_type: string, audiences: array<string>, source_label: string, verification_required: boolean, mode: string, regions: array<string>, "
    f"normalized_key: string, state: string, source_value: string, target_key: string, {_SUPPORT}>>, "
    f"ambiguities: array<struct<key: string, target_key: string, field: string, reason: string, note: string, {_SUPPORT}>>, links: array<{_LINK}>>"
)
CANDIDATE_DDL = (
    f"contract_version string, vocabulary_version string, source_snapshot_id string, observed_at string, evidence_spans array<struct<id: string, quote: string>>, "
    f"product struct<source_name: string, proposed_canonical_name: {_STEXT}, description: {_STEXT}, organization_roles: array<struct<organization_name: string, role: string, {_SUPPORT}>>, links: array<{_LINK}>, "
    f"facets: array<struct<namespace: string, concept_id: string, {_SUPPORT}>>, claimed_outcomes: array<{_STEXT}>>, opportunities array<{_OPPORTUNITY}>, "
    f"possible_canonical_matches array<struct<candidate_name: string, candidate_url: string, {_SUPPORT}>>"
)
