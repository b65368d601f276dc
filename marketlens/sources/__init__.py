"""Where the 19 raw tables come from and where finished tables go."""
