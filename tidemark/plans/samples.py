"""A rule set, lists and a small model that the registered queries use."""

from __future__ import annotations

from tidemark.operators.model import Calibrator, Model, parse_model
from tidemark.operators.ruleset import RuleSet
from tidemark.plans.checking import Scope

LISTS = {"trusted_domains": ("gmail.com", "yahoo.com"), "throwaway_domains": ("anonymous.com", "mail.com"), "no_domains": ()}
SCOPE = Scope(lists=LISTS)

RULES = """
# who may pass
allow if :uid_seconds_since_first: > 1209600 and :uid_seconds_since_last: > 259200
# what is stopped
block if :card_txn_count_1h: >= 3
block if lower(:purchaser_email_domain:) in @throwaway_domains and :card_amount_sum_24h: + :amount: > 300
shadow block if :risk_score: >= 30
# what is looked at
review if :product_code: = "purchase" and :amount: > 80
review if not (:recipient_email_domain: in @trusted_domains) and :device_txn_count_24h: > 40
review if is_missing(:device_info:) and :card_amount_ratio_7d: > 2.5
shadow review if starts_with(:device_info:, "dev") and :billing_region: != 103 or :distance: / :billing_country_code: > 2
"""

#: Rules that backtests propose.
PROPOSED = {
    "allow": "allow if :purchaser_email_domain: in @trusted_domains and :amount: < 20",
    "block": "block if :amount: > 60 and :card_txn_count_7d: >= 2",
    "review": 'review if :distinct_cards_per_email_24h: > 30 and :card_type: = "credit"',
}

MODEL = """tree
version=v4
num_class=1
num_tree_per_iteration=1
label_index=0
max_feature_idx=4
objective=binary sigmoid:1
feature_names=amount product_code card_txn_count_24h card_seconds_since_last distance
feature_infos=none none none none none

Tree=0
num_leaves=4
num_cat=1
split_feature=0 1 2
threshold=40.5 0 1.5
decision_type=10 1 2
left_child=1 -1 -3
right_child=2 -2 -4
leaf_value=-3.2 -2.6 -2.1 -0.4
internal_value=-2.7 -2.9 -1.8
cat_boundaries=0 1
cat_threshold=5
is_linear=0

Tree=1
num_leaves=3
num_cat=0
split_feature=3 4
threshold=3600 120
decision_type=10 4
left_child=-1 -2
right_child=1 -3
leaf_value=0.7 -0.15 0.2
internal_value=0.05 -0.1
is_linear=0

Tree=2
num_leaves=2
num_cat=0
split_feature=4
threshold=10
decision_type=8
left_child=-1
right_child=-2
leaf_value=0.3 -0.05
internal_value=0.01
is_linear=0

Tree=3
num_leaves=1
leaf_value=0.125

end of trees
"""
ENCODER = {"product_code": ["click", "purchase", "signup", "view"]}
CALIBRATION = Calibrator((-4.0, -2.5, -1.5, -0.5, 0.5), (0.002, 0.02, 0.11, 0.36, 0.83))


def model() -> Model:
    return parse_model(MODEL)


def rules() -> RuleSet:
    return RuleSet.load(RULES, SCOPE)
