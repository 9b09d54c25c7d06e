from lumenframe.cli import main

main()
