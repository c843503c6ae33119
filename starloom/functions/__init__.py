"""Column expressions shared by the build, the checks and the analyses."""
