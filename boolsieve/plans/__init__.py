"""Multi-step jobs: trees, forests, rules, learning, studies and reports."""
