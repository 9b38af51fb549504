"""Column expressions (native, whole-stage-codegen friendly)."""
