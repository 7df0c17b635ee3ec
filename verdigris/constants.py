"""Fixed values shared by the jobs. Every one is a default; functions take overrides."""

CUTOFF = "2026-02-20 00:00:00"

# Edge type -> weight.
EDGE_WEIGHTS = {
    "shares_device": 1.0,
    "shares_payment_instrument": 1.0,
    "shares_phone": 1.0,
    "shares_address": 0.7,
    "shares_ip_prefix": 0.3,
    "shares_coupon": 0.2,
}

# Edge type -> words used in explanations.
EDGE_LABELS = {
    "shares_device": "shared device",
    "shares_phone": "shared phone",
    "shares_payment_instrument": "shared payment instrument",
    "shares_address": "shared address",
    "shares_ip_prefix": "shared IP prefix",
    "shares_coupon": "shared coupon",
}

# Order column -> edge type for the four identity links.
IDENTITY_EDGE = {
    "device_id": "shares_device",
    "address_id": "shares_address",
    "phone_hash": "shares_phone",
    "instrument_id": "shares_payment_instrument",
}

# Order column -> short name used in feature columns.
ENTITY_SHORT = {
    "device_id": "device",
    "address_id": "address",
    "phone_hash": "phone",
    "instrument_id": "instrument",
}

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
IDENTITY_WINDOW_US = 7 * DAY_US
IP_WINDOW_US = 24 * HOUR_US
CREATION_WINDOW_US = HOUR_US
RARE_COUPON_ROWS = 10

COST_FP = 2_000
COST_FN = 15_000
ACCOUNT_GRID = 199
RING_GRID = 197
SEED_SCORE = 0.70
STRONG_EDGE = 0.70
MIN_CANDIDATE = 2

FORBIDDEN_COLUMNS = [
    "population_type",
    "abuse_ring_id",
    "true_ring_member",
    "ring_type",
    "ring_start_time",
    "ring_end_time",
]

EVIDENCE_FIELDS = [
    "proof_of_service",
    "explanation_letter",
    "refund_confirmation",
    "access_activity_log",
    "refund_cancellation_policy",
    "terms_and_conditions",
]

TIERS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Tier -> (action code, description, needs a human).
ACTIONS = {
    "CRITICAL": (
        "SOFT_HOLD_REFUND_PENDING_HUMAN_APPROVAL",
        "Soft-hold refund pending human approval",
        True,
    ),
    "HIGH": ("ROUTE_TO_HUMAN_REVIEW", "Route to human investigation/review", True),
    "MEDIUM": (
        "STEP_UP_REFUND_VERIFICATION",
        "Require step-up verification before processing refund",
        True,
    ),
    "LOW": ("NO_ACTION", "Monitor — no immediate refund action", False),
}

# Rank limits of the rank-only tier policy.
RANK_TIERS = [(10, "CRITICAL"), (25, "HIGH"), (65, "MEDIUM")]
# Score limits of the ring tier policy.
SCORE_TIERS = [(0.85, "CRITICAL"), (0.65, "HIGH"), (0.45, "MEDIUM")]

RING_TYPES = ["wardrobing", "promo_refund_farming", "friendly_fraud", "subtle_distributed"]
