"""Names and constants that are part of the data contract."""

# Frame categories of the visual triage.
CATEGORY_OK = "OK"
CATEGORY_OVER = "SEG_super"
CATEGORY_UNDER = "SEG_sub"
CATEGORY_AMBIGUOUS = "AMBIGUO"
CATEGORY_INVALID = "IMG_INVALIDA"
CATEGORY_UNTRIAGED = "NAO_TRIADA"

# Outcomes in the correction log and their rank.
STATUS_PRIORITY = {"ok": 3, "fechada": 3, "invalida": 2, "pulada": 1}

# Origin of a final area.
SOURCE_AUTO = "automatica"
SOURCE_PENDING_AUTO = "automatica_PENDENTE"
SOURCE_CORRECTED = "corrigida"
SOURCE_CLOSED = "corrigida_fechada"
SOURCE_INVALID = "invalida"
SOURCE_INVALID_TRIAGE = "invalida_triagem"
SOURCE_PENDING = "pendente_correcao"

# Provenance classes of a series.
PROVENANCE_CORRECTED = "corrigida"
PROVENANCE_AUTO = "automatica"
PROVENANCE_MIXED = "mista"

# Reasons attached to a curve.
REASON_PLAUSIBLE = "plausivel"
REASON_RANGE = "fora_[0,1]"
REASON_MONOTONE = "nao_monotonica"
REASON_JUMP = "salto_absurdo"
REASON_NO_BASELINE = "sem_baseline"
REASON_ZERO_BASELINE = "baseline_zero"
REASON_ONE_POINT = "serie_1_ponto"

# Limits of the plausibility rule.
RANGE_LOW, RANGE_HIGH = -0.05, 1.05
MONOTONE_TOLERANCE = 0.10
JUMP_LIMIT = 1.5

# Frame-flag limits (percent of the field).
FLAG_SMALL, FLAG_LARGE, FLAG_DISCORD, FLAG_RISE = 3.0, 85.0, 3.0, 5.0

# Overlap thresholds of the ranking metrics.
OVERLAP_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
