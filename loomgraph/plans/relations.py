"""Schemas of the relations that describe a program, and how their rows link.

Fixed values: names and column orders of the relations, the enumerations of expression and
statement kinds, and the links. They are data formats and have to be exactly these.
"""

from __future__ import annotations

from pyspark.sql import types as T

from loomgraph.plans.joinspec import Link, by_position, link

#: Columns by position. Identifiers are longs; see TEXT and NUMBER for the others.
COLUMNS = {
    "variable": ["id", "scope", "name"],
    "locations_ast": ["id", "module", "beginLine", "beginColumn", "endLine", "endColumn"],
    "py_Classes": ["id", "parent"],
    "py_Functions": ["id", "parent"],
    "py_Modules": ["id"],
    "py_boolops": ["id", "kind", "parent"],
    "py_bytes": ["id", "parent", "idx"],
    "py_cmpops": ["id", "kind", "parent", "idx"],
    "py_cmpop_lists": ["id", "parent"],
    "py_comprehensions": ["id", "parent", "idx"],
    "py_comprehension_lists": ["id", "parent"],
    "py_dict_items": ["id", "kind", "parent", "idx"],
    "py_dict_item_lists": ["id", "parent"],
    "py_exprs": ["id", "kind", "parent", "idx"],
    "py_expr_contexts": ["id", "kind", "parent"],
    "py_expr_lists": ["id", "parent", "idx"],
    "py_ints": ["id", "parent"],
    "py_locations": ["id", "parent"],
    "py_numbers": ["id", "parent", "idx"],
    "py_operators": ["id", "kind", "parent"],
    "py_parameter_lists": ["id", "parent"],
    "py_stmts": ["id", "kind", "parent", "idx"],
    "py_stmt_lists": ["id", "parent", "idx"],
    "py_strs": ["id", "parent", "idx"],
    "py_str_lists": ["id", "parent"],
    "py_unaryops": ["id", "kind", "parent"],
    "py_variables": ["id", "parent"],
    "py_successors": ["predecessor", "successor"],
    "py_true_successors": ["predecessor", "successor"],
    "py_exception_successors": ["predecessor", "successor"],
    "py_false_successors": ["predecessor", "successor"],
    "py_flow_bb_node": ["flownode", "realnode", "basicblock", "index"],
    "py_scope_flow": ["flow", "scope", "kind"],
    "py_idoms": ["node", "immediate_dominator"],
    "py_scopes": ["node", "scope"],
    "py_scope_location": ["id", "scope"],
    "py_ssa_phi": ["phi", "arg"],
    "py_ssa_var": ["id", "var"],
    "py_ssa_use": ["node", "var"],
    "py_ssa_defn": ["id", "node"],
    "call_graph": ["f1def", "f2def", "f1", "f2", "call"],
    # not part of the graph
    "except_hole": ["id", "kind", "parent", "idx"],
    "local_variable": ["id", "scope", "name"],
    "local_variable_old": ["id", "scope", "name"],
    "unused_var": ["unused", "var", "message", "name", "location"],
    "var_accesses": ["id", "context", "variable"],
}
AUXILIARY = {"except_hole", "local_variable", "local_variable_old", "unused_var", "var_accesses"}
TEXT = {"name", "message"}
TEXT_IDS = {"py_strs", "py_numbers", "py_bytes"}
NUMBER = {"kind", "idx", "index", "beginLine", "beginColumn", "endLine", "endColumn"}

#: Expression and statement kinds by number.
EXPRESSION_KINDS = (
    "Attribute",
    "BinaryExpr",
    "BoolExpr",
    "Bytes",
    "Call",
    "ClassExpr",
    "Compare",
    "Dict",
    "DictComp",
    "Ellipsis",
    "FunctionExpr",
    "GeneratorExp",
    "IfExp",
    "ImportExpr",
    "ImportMember",
    "Lambda",
    "List",
    "ListComp",
    "Name",
    "Num",
    "Repr",
    "Set",
    "SetComp",
    "Slice",
    "Starred",
    "Str",
    "Subscript",
    "Tuple",
    "UnaryExpr",
    "Yield",
    "YieldFrom",
    "TemplateDottedNotation",
    "Filter",
    "PlaceHolder",
    "Await",
    "Fstring",
    "FormattedValue",
    "AssignExpr",
    "SpecialOperation",
)
STATEMENT_KINDS = (
    "Assert",
    "Assign",
    "AugAssign",
    "Break",
    "Continue",
    "Delete",
    "ExceptStmt",
    "Exec",
    "Expr_stmt",
    "For",
    "Global",
    "If",
    "Import",
    "ImportStar",
    "Nonlocal",
    "Pass",
    "Print",
    "Raise",
    "Return",
    "Try",
    "While",
    "With",
    "TemplateWrite",
    "AnnAssign",
)

#: The links, a column (by position) of one relation and one of another.
LINKS = """
locations_ast.1 <-> py_Modules.0
py_Classes.1 <-> py_exprs.0
py_Functions.1 <-> py_exprs.0
py_boolops.2 <-> py_exprs.0
py_bytes.1 <-> py_exprs.0
py_cmpop_lists.1 <-> py_exprs.0
py_cmpops.2 <-> py_cmpop_lists.0
py_comprehension_lists.1 <-> py_exprs.0
py_comprehensions.1 <-> py_comprehension_lists.0
py_dict_item_lists.1 <-> py_exprs.0
py_dict_items.2 <-> py_dict_item_lists.0
py_exception_successors.0 <-> py_flow_bb_node.0
py_exception_successors.1 <-> py_flow_bb_node.0
py_expr_contexts.2 <-> py_exprs.0
py_expr_lists.1 <-> py_Functions.0
py_expr_lists.1 <-> py_comprehensions.0
py_expr_lists.1 <-> py_exprs.0
py_expr_lists.1 <-> py_stmts.0
py_exprs.2 <-> py_Functions.0
py_exprs.2 <-> py_dict_items.0
py_exprs.2 <-> py_expr_lists.0
py_exprs.2 <-> py_exprs.0
py_exprs.2 <-> py_parameter_lists.0
py_exprs.2 <-> py_stmts.0
py_false_successors.0 <-> py_flow_bb_node.0
py_false_successors.1 <-> py_flow_bb_node.0
py_flow_bb_node.1 <-> py_Classes.0
py_flow_bb_node.1 <-> py_Functions.0
py_flow_bb_node.1 <-> py_Modules.0
py_flow_bb_node.1 <-> py_comprehensions.0
py_flow_bb_node.1 <-> py_dict_items.0
py_flow_bb_node.1 <-> py_exprs.0
py_flow_bb_node.1 <-> py_stmts.0
py_flow_bb_node.2 <-> py_flow_bb_node.0
py_idoms.0 <-> py_flow_bb_node.0
py_idoms.1 <-> py_flow_bb_node.0
py_ints.1 <-> py_exprs.0
py_locations.0 <-> locations_ast.0
py_locations.1 <-> py_comprehensions.0
py_locations.1 <-> py_dict_items.0
py_locations.1 <-> py_stmts.0
py_locations.1 <-> py_strs.1
py_numbers.1 <-> py_exprs.0
py_operators.2 <-> py_exprs.0
py_parameter_lists.1 <-> py_Functions.0
py_scope_flow.0 <-> py_flow_bb_node.0
py_scope_flow.1 <-> py_Classes.0
py_scope_flow.1 <-> py_Functions.0
py_scope_flow.1 <-> py_Modules.0
py_scope_location.0 <-> locations_ast.0
py_scope_location.1 <-> py_Classes.0
py_scope_location.1 <-> py_Functions.0
py_scope_location.1 <-> py_Modules.0
py_scopes.0 <-> py_exprs.0
py_scopes.0 <-> py_stmts.0
py_scopes.1 <-> py_Classes.0
py_scopes.1 <-> py_Functions.0
py_scopes.1 <-> py_Modules.0
py_ssa_defn.0 <-> py_ssa_var.0
py_ssa_defn.1 <-> py_flow_bb_node.0
py_ssa_phi.0 <-> py_ssa_var.0
py_ssa_phi.1 <-> py_ssa_var.0
py_ssa_use.0 <-> py_flow_bb_node.0
py_ssa_use.1 <-> py_ssa_var.0
py_ssa_var.1 <-> variable.0
py_stmt_lists.1 <-> py_Classes.0
py_stmt_lists.1 <-> py_Functions.0
py_stmt_lists.1 <-> py_Modules.0
py_stmt_lists.1 <-> py_stmts.0
py_stmts.2 <-> py_stmt_lists.0
py_str_lists.1 <-> py_stmts.0
py_strs.1 <-> py_Classes.0
py_strs.1 <-> py_Functions.0
py_strs.1 <-> py_Modules.0
py_strs.1 <-> py_dict_items.0
py_strs.1 <-> py_exprs.0
py_strs.1 <-> py_str_lists.0
py_successors.0 <-> py_flow_bb_node.0
py_successors.1 <-> py_flow_bb_node.0
py_true_successors.0 <-> py_flow_bb_node.0
py_true_successors.1 <-> py_flow_bb_node.0
py_unaryops.2 <-> py_exprs.0
py_variables.0 <-> variable.0
py_variables.1 <-> py_exprs.0
variable.1 <-> py_Classes.0
variable.1 <-> py_Functions.0
variable.1 <-> py_Modules.0
call_graph.0 <-> call_graph.1
"""


def program_links() -> list[Link]:
    """All links between the relations of a program, with column names."""
    return by_position([link(line) for line in LINKS.strip().splitlines()], COLUMNS)


def schema(relation: str) -> T.StructType:
    """Types of a relation's columns: identifiers long, numbers int, names and literal values string."""

    def kind(at: int, column: str) -> T.DataType:
        if column in TEXT or (at == 0 and relation in TEXT_IDS):
            return T.StringType()
        return T.IntegerType() if column in NUMBER else T.LongType()

    return T.StructType([T.StructField(c, kind(i, c)) for i, c in enumerate(COLUMNS[relation])])
