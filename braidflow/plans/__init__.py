"""The pipeline algebra: nodes, rules, execution, freshness, results and text views."""

from .display import dag, print_dag
from .executor import default_jobs, default_memory_mb, execute, run, run_node
from .nodes import Branch, Force, ForEach, Node, NoWork, Parallel, Pipeline, Reduce, Resourced, Retry, Sequence, Shell, Sql, Step, Timeout, branch, count_steps, for_each, lift, shell, shell_pipe, sql, step, steps, with_resources
from .results import PipelineError, Results, StepFailure, StepResult
from .rules import NoRule, Rule, RuleChain, RuleCycle, RuleValuePipe, Workflow, check, explain, find_rule, plan, resolve, rule
from .state import StateTable, is_fresh, step_hash

__all__ = [
    "Branch", "Force", "ForEach", "Node", "NoRule", "NoWork", "Parallel", "Pipeline", "PipelineError", "Reduce", "Resourced", "Results", "Retry", "Rule", "RuleChain", "RuleCycle", "RuleValuePipe", "Sequence", "Shell", "Sql", "StateTable", "Step",
    "StepFailure", "StepResult", "Timeout", "Workflow", "branch", "check", "count_steps", "dag", "default_jobs", "default_memory_mb", "execute", "explain", "find_rule", "for_each", "is_fresh", "lift", "plan", "print_dag", "resolve", "rule", "run", "run_node", "shell", "shell_pipe", "sql",
    "step", "step_hash", "steps", "with_resources",
]
