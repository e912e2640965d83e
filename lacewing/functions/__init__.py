from lacewing.functions.columns import indexed, placed_in_group, rules_worth_inlining, rules_worth_inlining_decomposed, running_total

__all__ = ["indexed", "placed_in_group", "rules_worth_inlining", "rules_worth_inlining_decomposed", "running_total"]
