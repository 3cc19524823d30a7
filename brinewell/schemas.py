"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

MARKETS = "market_id string, platform string, question_text string, close_time string, resolved_outcome int, category string"
BETS = "id bigint, market_id string, ts_ns bigint, prob_before double, prob_after double, amount double, shares double, is_limit_order int"
PROBABILITIES = "id bigint, market_id string, ts_ns bigint, probability double, volume_24h double"
FEATURES = "id bigint, market_id string, ts_ns bigint, prob_velocity double, bet_arrival_rate double, realized_vol double"
CROSS_SOURCE = "id bigint, market_id string, polled_at string, community_prediction double"
MATCHES = "id bigint, manifold_market_id string, platform string, external_market_id string, confidence double, status string"
PREDICTIONS = "id bigint, market_id string, ts_ns bigint, p_model double, p_market double, edge double, ev double"
SIGNALS = "id bigint, type string, market_refs string, edge double, detected_at string, details_json string"

WIRE_BET = (
    "struct<id: string, contractId: string, createdTime: bigint, probBefore: double, probAfter: double, amount: double, "
    "shares: double, isFilled: boolean, isCancelled: boolean, limitProb: double>"
)
FRAME = f"type string, topic string, txid bigint, success boolean, data struct<bets: array<{WIRE_BET}>>"
POLYMARKET = (
    "conditionId string, id string, question string, outcomes string, outcomePrices string, volumeNum double, volume string, "
    "endDate string, active boolean, closed boolean"
)
