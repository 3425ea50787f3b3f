"""Relational operators: views, pair features, labels, policy, judge, evaluation."""
